"""The test tables as a virtual dataset."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dataset import Dataset
from ..sources.relational import Property, RelationalSource, TableMap

BASE = "http://tables.test/"
PREFIX = f"PREFIX : <{BASE}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX agg: <{BASE}agg#> "


def _props(ints: str = "", texts: str = "", doubles: str = "", stamps: str = "", refs: dict[str, tuple[str, str]] | None = None, **more: Property) -> dict[str, Property]:
    out = {BASE + c: Property(f"CAST({c} AS BIGINT)", "int") for c in ints.split()}
    out |= {BASE + c: Property(c, "str") for c in texts.split()}
    out |= {BASE + c: Property(c, "dbl") for c in doubles.split()}
    out |= {BASE + c: Property(c, "dt") for c in stamps.split()}
    out |= {BASE + n: Property(f"CAST({c} AS BIGINT)", "ref", f"{BASE}{cls}/") for n, (c, cls) in (refs or {}).items()}
    return out | {BASE + n: p for n, p in more.items()}


def _map(table: str, cls: str, key: str, props: dict[str, Property], graph=None) -> TableMap:
    return TableMap(table, BASE + cls, f"{BASE}{table}/", f"CAST({key} AS BIGINT)" if " " not in key and "(" not in key else key, props, graph)


_LINE = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
MAPS = [
    _map("region", "Region", "r_regionkey", _props("r_regionkey", "r_name")),
    _map("nation", "Nation", "n_nationkey", _props("n_nationkey", "n_name", refs={"n_region": ("n_regionkey", "region")})),
    _map("customer", "Customer", "c_custkey", _props("c_custkey", "c_name c_mktsegment", "c_acctbal", refs={"c_nation": ("c_nationkey", "nation")}, c_sponsor=Property("IF(c_custkey > 0, (c_custkey - 1) DIV 2, NULL)", "ref", BASE + "customer/"))),
    _map("supplier", "Supplier", "s_suppkey", _props("s_suppkey", "s_name", "s_acctbal", refs={"s_nation": ("s_nationkey", "nation")})),
    _map("part", "Part", "p_partkey", _props("p_partkey p_size", "p_name p_brand p_type", "p_retailprice")),
    _map("orders", "Order", "o_orderkey", _props("o_orderkey", "o_orderstatus o_orderpriority", "o_totalprice", "o_orderdate", {"o_customer": ("o_custkey", "customer")})),
    # its rows have no shorter key: order and line number repeat
    _map("lineitem", "Lineitem", f"concat_ws('|', {', '.join(_LINE.split())})", _props("l_linenumber", "l_returnflag l_linestatus", "l_quantity l_extendedprice l_discount l_tax", "l_shipdate", {"l_order": ("l_orderkey", "orders"), "l_part": ("l_partkey", "part"), "l_supplier": ("l_suppkey", "supplier")})),
    _map("events", "Event", "event_id", _props("event_id user_id", "event_type props", "value", "ts")),
    _map("documents", "Document", "doc_id", _props("doc_id n_chars", "lang source", text=Property("text", "lang", lang="lang")), (BASE + "source/", "source")),
]


def dataset(spark: SparkSession, sf_dir: str, **more) -> Dataset:
    """The mapped tables of a folder."""
    return Dataset(spark, RelationalSource(spark, MAPS, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")), **more)
