"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); the component is its smallest node.

    Each round rewires every node's neighbours to the smallest one near it, so
    rounds grow with the logarithm of the diameter.  A round is one aggregate
    (combined before the shuffle) and one join that skew handling may split; no
    neighbour list is ever gathered.  Null ends and loops are ignored; an empty
    table has no components.
    """
    edges = stored(links.select("a", "b").where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    while True:
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.selectExpr("u", "m AS v").unionByName(small.selectExpr("v AS u", "m AS v")).where("u <> v").distinct()
        new = stored(small, "edges")
        # done when it is a forest of stars: no node is both a centre and a member
        rest = new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        multi = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        edges = new
        if not rest and not multi:
            break
    stars = edges.selectExpr("u AS node", "v AS component")
    return stars.unionByName(edges.selectExpr("v AS node", "v AS component")).distinct()
