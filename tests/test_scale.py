"""Plans that must not grow faster than their input."""

from __future__ import annotations

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LOOPS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exists_nested_meets_by_equality(spark):
    found = plan(entry.queries()["exists_nested"](spark, SF))
    assert not any(x in found for x in LOOPS)


def test_not_exists_nested_meets_by_equality(spark):
    found = plan(entry.queries()["not_exists_nested"](spark, SF))
    assert not any(x in found for x in LOOPS)


def test_path_opt_starts_at_what_is_joined(spark):
    found = plan(entry.queries()["path_opt"](spark, SF))
    assert not any(x in found for x in LOOPS)
    # zero steps are made for customers alone
    assert "lineitem" not in found


def test_path_plus_has_no_cross_product(spark):
    assert not any(x in plan(entry.queries()["path_plus"](spark, SF)) for x in LOOPS)


def test_path_range_has_no_cross_product(spark):
    assert not any(x in plan(entry.queries()["path_range"](spark, SF)) for x in LOOPS)


def test_path_neg_reads_the_table_of_its_start(spark):
    found = plan(entry.queries()["path_neg"](spark, SF))
    assert "nation" in found and "lineitem" not in found


def test_rules_keep_what_is_known_apart(spark):
    """A rule that gives its own body back does not read the data again, and a closure is a set though its input is not."""
    from quadloom.operators import rules as R

    t = spark.createDataFrame([("Ix", "Ip", "Iy"), ("Ix", "Ip", "Iy"), ("Ip", f"I{R.RDFS}subPropertyOf", "Ip")], "s string, p string, o string")
    sub = next(r for r in R.RDFS_RULES if r.name == "rdfs7")
    assert R._apply(sub, t, t, True, R.count(t), R.count(t)) == [] or not [x for df in R._apply(sub, t, t, True, R.count(t), R.count(t)) for x in df.collect()]
    closed = R.closure(t, [sub, R.rule("back", "?x <p> ?y -> ?y <q> ?x")])
    assert sorted(map(tuple, closed.collect())) == sorted([("Ix", "Ip", "Iy"), ("Ip", f"I{R.RDFS}subPropertyOf", "Ip"), ("Iy", "Iq", "Ix")])


def test_new_triples_are_compared_with_their_own_predicates(spark, tmp_path):
    from quadloom.operators import rules as R

    spark.createDataFrame([("Ix", "Ip", "Iy"), ("Ix", "Ir", "Iz")], "s string, p string, o string").write.partitionBy("p").parquet(str(tmp_path / "q"))
    every = spark.read.schema("s string, o string, p string").parquet(str(tmp_path / "q")).select("s", "p", "o")
    delta, counts = R.missing(spark.createDataFrame([("Ix", "Iq", "Iy"), ("Ix", "Iq", "Iy"), ("Ix", "Ip", "Iy")], every.schema), every)
    assert counts == {"Iq": 1} and delta.count() == 1


def test_description_reads_what_may_touch_its_nodes(spark):
    from quadloom.plans.tables import BASE, dataset

    source = dataset(spark, SF).source
    nodes = lambda *x: spark.createDataFrame([(n,) for n in x], "n string")
    found = plan(source.touching(nodes(f"I{BASE}region/1")))
    assert "r_name" in found and "l_quantity" not in found and "c_name" not in found
    some = nodes(f"I{BASE}customer/3", f"I{BASE}Region", "Lx:string\x1f\x1fBUILDING", f"I{BASE}orders/7", "Bnone")
    quads = source.all_quads().where("g IS NULL").select("s", "p", "o")
    want = quads.join(some.withColumnRenamed("n", "s"), "s", "left_semi").union(quads.join(some.withColumnRenamed("n", "o"), "o", "left_semi").select("s", "p", "o")).distinct()
    got = source.touching(some).distinct()
    assert got.count() == want.count() > 20 and got.exceptAll(want).isEmpty()


def test_shape_rules_leave_the_stored_quads_where_they_are(spark):
    from quadloom.operators import shapes as S
    from quadloom.plans.catalogue import _turtle

    d = _turtle(spark, ":a a :C ; :size 3 . :b a :C .").stored()
    shapes = _turtle(spark, ':S a sh:NodeShape ; sh:targetClass :C ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :seen ; sh:object "x" ] .')
    out = S.rules(d, shapes)
    assert out.count() == 5 and out.where("p LIKE '%seen'").count() == 2
    # a constant predicate still prunes files, and a quad that is read is one of a set
    assert "PartitionFilters: [isnotnull(p" in plan(out.where("p = 'Inone'"))


def test_typed_nodes_are_not_given_again(spark):
    from quadloom.operators import rules as R

    t = spark.createDataFrame([("Ix", f"I{R.RDF}type", f"I{R.RDFS}Resource")], "s string, p string, o string")
    four = next(r for r in R.RDFS_RULES if r.name == "rdfs4a")
    assert not [x for df in R._apply(four, t, t, True, R.count(t), R.count(t)) for x in df.collect()]


def test_layers_write_only_what_is_new(spark):
    from quadloom.operators import rules as R

    t = spark.createDataFrame([("Ix", "Ip", "Iy"), ("Ix", "Ip", "Iy"), ("Iz", "Ip", "Iy"), ("Iz", "Ir", "Iy")], "s string, p string, o string")
    base, deltas = [t], []
    for layer in R.strata([R.rule("idle", "?c <p> ?n . not ?c <buys> ?n -> ?n <idle> ?c"), R.rule("buys", "?c <r> ?n -> ?c <buys> ?n")]):
        R._closure(base, deltas, layer, False, R.count(t))
    assert [[tuple(x) for x in d.collect()] for d in deltas] == [[("Iz", "Ibuys", "Iy")], [("Iy", "Iidle", "Ix")]]
