"""Some registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "tpch_q1 bgp_join_fk optional_filter values_undef minus exists_in_or lateral_topk graph_named path_star group_concat percentile construct update_modify shacl_logic rdfs_subclass datalog_rules exists_nested not_exists_nested minus_unbound list_functions path_opt optional_chain_unbound shop_star_join shop_update_modify shop_update_delete shop_rules shop_rules_negation shop_rdfs shop_owl_inverse shop_shacl shop_shacl_rule shop_void".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)



@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name, column", [("list_functions", "list"), ("path_opt", "a"), ("optional_chain_unbound", "c")])
def test_whole_tables(spark, name, column):
    ids = {int(str(r[0]).rsplit("/", 1)[-1]) for r in entry.queries()[name](spark, SF).select(column).collect()}
    table, key = ("orders", "o_custkey") if column == "list" else ("customer", "c_custkey")
    assert ids == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
