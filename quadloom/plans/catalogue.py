"""The queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import BASE, PREFIX, dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sparql(name: str, text: str, sql: str | None = None, **more) -> None:
    """Registers a SPARQL query over the mapped tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset(spark, sf_dir, **more).query(PREFIX + text).df

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql.replace("$B", BASE)


sparql(
    "tpch_q1",
    """SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (SUM(?p) AS ?sum_base) (SUM(?p * (1 - ?d)) AS ?sum_disc) (SUM(?p * (1 - ?d) * (1 + ?t)) AS ?sum_charge)
      (AVG(?q) AS ?avg_qty) (AVG(?p) AS ?avg_price) (AVG(?d) AS ?avg_disc) (COUNT(*) AS ?n)
    WHERE { ?l a :Lineitem ; :l_returnflag ?flag ; :l_linestatus ?status ; :l_quantity ?q ; :l_extendedprice ?p ; :l_discount ?d ; :l_tax ?t ; :l_shipdate ?s
      FILTER(?s <= "1998-09-02T00:00:00"^^xsd:dateTime) } GROUP BY ?flag ?status ORDER BY ?flag ?status""",
    """SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
      sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*)::BIGINT AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
sparql("bgp_star", "SELECT ?q ?d ?f WHERE { ?l a :Lineitem ; :l_quantity ?q ; :l_shipdate ?d ; :l_returnflag ?f }", "SELECT l_quantity AS q, l_shipdate AS d, l_returnflag AS f FROM lineitem")
sparql(
    "bgp_join_fk",
    "SELECT ?nation (SUM(?p) AS ?total) (COUNT(*) AS ?n) WHERE { ?l :l_order ?o ; :l_extendedprice ?p . ?o :o_customer ?c . ?c :c_nation/:n_name ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, sum(l_extendedprice) AS total, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
sparql("bgp_const_object", 'SELECT ?n WHERE { ?c :c_mktsegment "BUILDING" ; :c_name ?n }', "SELECT c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("bgp_const_subject", "SELECT ?n ?s WHERE { <$B/part/7> :p_name ?n ; :p_size ?s }".replace("$B/", BASE), "SELECT p_name AS n, p_size::BIGINT AS s FROM part WHERE p_partkey = 7")
sparql("bgp_repeated_var", "SELECT ?x WHERE { ?o :o_orderkey ?x . ?c :c_custkey ?x }", "SELECT o_orderkey AS x FROM orders JOIN customer ON c_custkey = o_orderkey")
sparql("bgp_var_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x a :Nation ; ?p ?v } GROUP BY ?p",
    "SELECT p, count(*)::BIGINT AS n FROM nation, (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type'), ('$Bn_nationkey'), ('$Bn_name'), ('$Bn_region')) AS t(p) GROUP BY 1")
sparql("filter_range", "SELECT ?q ?p WHERE { ?l :l_quantity ?q ; :l_extendedprice ?p FILTER(?q >= 10 && ?q < 12) }", "SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12")
sparql("filter_in", 'SELECT ?n ?s WHERE { ?c :c_name ?n ; :c_mktsegment ?s FILTER(?s IN ("BUILDING", "MACHINERY")) }', "SELECT c_name AS n, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sparql("filter_not_in", 'SELECT ?n ?s WHERE { ?c :c_name ?n ; :c_mktsegment ?s FILTER(?s NOT IN ("BUILDING", "MACHINERY")) }', "SELECT c_name AS n, c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
sparql("filter_logic", 'SELECT ?n WHERE { ?p :p_name ?n ; :p_size ?s ; :p_brand ?b FILTER(!(?s > 10) || (?s = 50 && ?b != "Brand#11")) }', "SELECT p_name AS n FROM part WHERE p_size <= 10 OR (p_size = 50 AND p_brand <> 'Brand#11')")
sparql("bind_arith", "SELECT ?k ?net WHERE { ?l :l_linenumber ?k ; :l_extendedprice ?p ; :l_discount ?d BIND(?p * (1 - ?d) AS ?net) }", "SELECT l_linenumber::BIGINT AS k, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
sparql("optional", "SELECT ?c ?k WHERE { ?x :c_custkey ?c OPTIONAL { ?o :o_customer ?x ; :o_orderkey ?k } }", "SELECT c_custkey AS c, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
sparql("optional_filter", "SELECT ?c ?k WHERE { ?x :c_custkey ?c ; :c_acctbal ?b OPTIONAL { ?o :o_customer ?x ; :o_orderkey ?k ; :o_totalprice ?t FILTER(?t > 30 * ?b) } }",
    "SELECT c_custkey AS c, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 30 * c_acctbal")
sparql("optional_chain_unbound", """SELECT ?c ?t WHERE { ?x :c_custkey ?c ; :c_mktsegment ?g
      OPTIONAL { ?x :c_acctbal ?b . BIND("pre" AS ?t) FILTER(?b < 0) } OPTIONAL { VALUES (?g ?t) { ("BUILDING" "pre") ("BUILDING" "post") ("MACHINERY" "post") } } }""",
    """WITH a AS (SELECT c_custkey AS c, c_mktsegment AS g, CASE WHEN c_acctbal < 0 THEN 'pre' END AS t FROM customer),
      v(g, t) AS (VALUES ('BUILDING', 'pre'), ('BUILDING', 'post'), ('MACHINERY', 'post'))
    SELECT a.c, coalesce(a.t, v.t) AS t FROM a LEFT JOIN v ON a.g = v.g AND (a.t = v.t OR a.t IS NULL)""")  # fmt: skip
sparql("exists_nested", """SELECT ?c WHERE { ?x :c_custkey ?c ; :c_acctbal ?b
      FILTER EXISTS { { ?o :o_customer ?x ; :o_totalprice ?t FILTER(?t > 60 * ?b) } UNION { ?x :c_nation/:n_region/:r_regionkey ?r FILTER(?r * 1000 > ?b) } } }""",
    """SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey * 1000 > c_acctbal
      OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 60 * c_acctbal)""")  # fmt: skip
sparql("not_exists_nested", """SELECT ?c WHERE { ?x :c_custkey ?c ; :c_acctbal ?b
      FILTER NOT EXISTS { ?o :o_customer ?x OPTIONAL { ?o :o_totalprice ?t FILTER(?t > 60 * ?b) } FILTER(!BOUND(?t)) } }""",
    "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 60 * c_acctbal)")
sparql("minus_unbound", """SELECT ?c ?t WHERE { ?x :c_custkey ?c ; :c_acctbal ?b OPTIONAL { ?x :c_mktsegment ?t FILTER(?b > 0) }
      MINUS { ?x :c_sponsor ?y OPTIONAL { ?x :c_mktsegment ?t FILTER(?t != "BUILDING") } } }""",
    """SELECT c_custkey AS c, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS t FROM customer
      WHERE NOT (c_custkey > 0 AND (c_mktsegment = 'BUILDING' OR c_acctbal <= 0 OR c_mktsegment <> 'BUILDING'))""")  # fmt: skip
sparql("union", "SELECT ?n WHERE { { ?x :c_name ?n } UNION { ?x :s_name ?n } }", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier")
sparql("union_hetero", "SELECT ?n ?b ?s WHERE { { ?x :c_name ?n ; :c_acctbal ?b } UNION { ?x :p_name ?n ; :p_size ?s } }", "SELECT c_name AS n, c_acctbal AS b, NULL::BIGINT AS s FROM customer UNION ALL SELECT p_name, NULL, p_size::BIGINT FROM part")
sparql("minus", "SELECT ?c WHERE { ?x :c_custkey ?c MINUS { ?o :o_customer ?x ; :o_orderstatus \"F\" } }", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
sparql("minus_disjoint", "SELECT ?c WHERE { ?x :c_custkey ?c MINUS { ?y :r_name ?z } }", "SELECT c_custkey AS c FROM customer")
sparql("exists", "SELECT ?c WHERE { ?x :c_custkey ?c FILTER EXISTS { ?o :o_customer ?x ; :o_totalprice ?t FILTER(?t > 300000) } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sparql("not_exists", "SELECT ?c WHERE { ?x :c_custkey ?c FILTER NOT EXISTS { ?o :o_customer ?x } }", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sparql("exists_correlated_filter", "SELECT ?c WHERE { ?x :c_custkey ?c ; :c_acctbal ?b FILTER EXISTS { ?o :o_customer ?x ; :o_totalprice ?t FILTER(?t < ?b * 10) } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 10)")
sparql("exists_in_or", 'SELECT ?c WHERE { ?x :c_custkey ?c ; :c_mktsegment ?s FILTER(?s = "BUILDING" || EXISTS { ?o :o_customer ?x ; :o_orderstatus "P" }) }', "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sparql("values", 'SELECT ?n ?w WHERE { VALUES (?s ?w) { ("BUILDING" 1) ("MACHINERY" 2) } ?c :c_mktsegment ?s ; :c_name ?n }', "SELECT c_name AS n, w::BIGINT AS w FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) AS v(s, w) ON c_mktsegment = s")
sparql("values_undef", 'SELECT ?n ?z WHERE { ?c :p_brand ?s ; :p_name ?n ; :p_size ?z } VALUES (?s ?z) { ("Brand#11" UNDEF) (UNDEF 7) }', "SELECT p_name AS n, p_size::BIGINT AS z FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT p_name, p_size::BIGINT FROM part WHERE p_size = 7")
sparql("subselect", "SELECT ?c ?n ?b WHERE { { SELECT ?x (COUNT(*) AS ?n) WHERE { ?o :o_customer ?x } GROUP BY ?x } ?x :c_custkey ?c ; :c_acctbal ?b FILTER(?n > 12) }",
    "SELECT c_custkey AS c, n, c_acctbal AS b FROM customer JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 12")
sparql("graph_named", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?d :n_chars ?k FILTER(?k > 1000) } } GROUP BY ?g", "SELECT '$Bsource/' || source AS g, count(*)::BIGINT AS n FROM documents WHERE n_chars > 1000 GROUP BY 1")
sparql("graph_const", "SELECT ?k WHERE { GRAPH <$B> { ?d :n_chars ?k } }".replace("$B", BASE + "source/src1"), "SELECT n_chars AS k FROM documents WHERE source = 'src1'")
sparql("from_merge", "SELECT ?l (COUNT(*) AS ?n) FROM <$Bsrc1> FROM <$Bsrc2> WHERE { ?d :lang ?l } GROUP BY ?l".replace("$B", BASE + "source/"), "SELECT lang AS l, count(*)::BIGINT AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
sparql("from_named", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED <$Bsrc1> FROM NAMED <$Bsrc2> WHERE { GRAPH ?g { ?d :lang ?l } } GROUP BY ?g".replace("$B", BASE + "source/"), "SELECT '$Bsource/' || source AS g, count(*)::BIGINT AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
sparql("lateral_topk", "SELECT ?c ?k ?t WHERE { ?x :c_custkey ?c LATERAL { SELECT ?x ?k ?t WHERE { ?o :o_customer ?x ; :o_orderkey ?k ; :o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 2 } }",
    "SELECT c, k, t FROM (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) JOIN customer ON c = c_custkey WHERE rn <= 2")
sparql("lateral_aggregate", "SELECT ?c ?n WHERE { ?x :c_custkey ?c LATERAL { SELECT ?x (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?x } GROUP BY ?x } }", "SELECT c_custkey AS c, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
sparql("distinct", "SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
sparql("reduced", "SELECT (COUNT(*) AS ?n) WHERE { { SELECT REDUCED ?s ?k WHERE { ?o :o_orderkey ?k ; :o_orderstatus ?s } } }", "SELECT count(*)::BIGINT AS n FROM orders")
sparql("orderby_limit", "SELECT ?k ?t WHERE { ?o :o_orderkey ?k ; :o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 20")
sparql("slice", "SELECT ?k WHERE { ?o :o_orderkey ?k } ORDER BY ?k LIMIT 10 OFFSET 25", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 10 OFFSET 25")
sparql("ask", 'ASK { ?c :c_mktsegment "BUILDING" ; :c_acctbal ?b FILTER(?b > 9000) }', "SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
sparql("ask_false", 'ASK { ?c :c_mktsegment "NOTHING" }', "SELECT false AS answer")
_NT = "SELECT 'I$Bnation/' || n_nationkey AS s, 'I$Bin' AS p, 'Lx:string' || chr(31) || chr(31) || r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey"
sparql("construct", "CONSTRUCT { ?n :in ?r } WHERE { ?n :n_region/:r_name ?r }", _NT)
sparql("construct_where", "CONSTRUCT WHERE { ?n :n_region ?r }", "SELECT 'I$Bnation/' || n_nationkey AS s, 'I$Bn_region' AS p, 'I$Bregion/' || n_regionkey AS o FROM nation")
sparql("construct_set", "CONSTRUCT { ?c :segment ?s . ?s :bad ?c } WHERE { ?x :c_nation ?c ; :c_mktsegment ?s }", "SELECT DISTINCT 'I$Bnation/' || c_nationkey AS s, 'I$Bsegment' AS p, 'Lx:string' || chr(31) || chr(31) || c_mktsegment AS o FROM customer")
sparql("describe", f"DESCRIBE <{BASE}region/1>", """SELECT 'I$Bregion/1' AS s, 'I$Br_name' AS p, 'Lx:string' || chr(31) || chr(31) || r_name AS o FROM region WHERE r_regionkey = 1
    UNION ALL SELECT 'I$Bregion/1', 'I$Br_regionkey', 'Lx:integer' || chr(31) || chr(31) || '1' UNION ALL SELECT 'I$Bregion/1', 'Ihttp://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'I$BRegion'
    UNION ALL SELECT 'I$Bnation/' || n_nationkey, 'I$Bn_region', 'I$Bregion/1' FROM nation WHERE n_regionkey = 1""")  # fmt: skip
# aggregates
sparql("group_count", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*)::BIGINT AS n FROM orders GROUP BY 1")
sparql("count_distinct", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_orderstatus ?s ; :o_customer ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey)::BIGINT AS n FROM orders GROUP BY 1")
sparql("sum_avg", "SELECT ?b (SUM(?z) AS ?sum_size) (xsd:double(AVG(?z)) AS ?avg_size) (AVG(?p) AS ?avg_price) WHERE { ?x :p_brand ?b ; :p_size ?z ; :p_retailprice ?p } GROUP BY ?b", "SELECT p_brand AS b, sum(p_size)::BIGINT AS sum_size, avg(p_size) AS avg_size, avg(p_retailprice) AS avg_price FROM part GROUP BY 1")
sparql("sum_distinct", "SELECT ?b (SUM(DISTINCT ?z) AS ?s) WHERE { ?x :p_brand ?b ; :p_size ?z } GROUP BY ?b", "SELECT p_brand AS b, sum(DISTINCT p_size)::BIGINT AS s FROM part GROUP BY 1")
sparql("min_max", "SELECT ?g (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MAX(?n) AS ?last) WHERE { ?c :c_mktsegment ?g ; :c_acctbal ?b ; :c_name ?n } GROUP BY ?g", "SELECT c_mktsegment AS g, min(c_acctbal) AS lo, max(c_acctbal) AS hi, max(c_name) AS last FROM customer GROUP BY 1")
sparql("having", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :o_customer ?x . ?x :c_custkey ?c } GROUP BY ?c HAVING(COUNT(*) > 12)", "SELECT o_custkey AS c, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
sparql("group_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate)::BIGINT AS y, count(*)::BIGINT AS n FROM orders GROUP BY 1")
sparql("implicit_group", "SELECT (COUNT(*) AS ?n) (MAX(?t) AS ?m) WHERE { ?o :o_totalprice ?t }", "SELECT count(*)::BIGINT AS n, max(o_totalprice) AS m FROM orders")
sparql("group_empty", "SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?s) WHERE { ?x :p_size ?z FILTER(?z > 1000) }", "SELECT 0::BIGINT AS n, 0::BIGINT AS s")
sparql("group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?names) WHERE { SELECT ?r ?n WHERE { ?x :n_region/:r_name ?r ; :n_name ?n } ORDER BY DESC(?n) } GROUP BY ?r',
    "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("sample", "SELECT ?r (SAMPLE(?n) AS ?any) WHERE { ?x :n_region ?y . ?y :r_name ?r, ?n } GROUP BY ?r", "SELECT r_name AS r, r_name AS \"any\" FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
sparql("median", "SELECT ?f (AGG(agg:MEDIAN, ?q) AS ?m) WHERE { ?l :l_returnflag ?f ; :l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, median(l_quantity) AS m FROM lineitem GROUP BY 1")
sparql("percentile", "SELECT ?f (AGG(agg:PERCENTILE, ?q; P=0.9) AS ?m) WHERE { ?l :l_returnflag ?f ; :l_extendedprice ?q } GROUP BY ?f", "SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.9) AS m FROM lineitem GROUP BY 1")
sparql("stddev", "SELECT ?f (AGG(agg:STDDEV, ?q) AS ?s) (AGG(agg:STDDEV_POP, ?q) AS ?p) WHERE { ?l :l_returnflag ?f ; :l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, stddev_samp(l_quantity) AS s, stddev_pop(l_quantity) AS p FROM lineitem GROUP BY 1")
sparql("variance", "SELECT ?f (AGG(agg:VARIANCE, ?q) AS ?s) (AGG(agg:VAR_POP, ?q) AS ?p) WHERE { ?l :l_returnflag ?f ; :l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, var_samp(l_quantity) AS s, var_pop(l_quantity) AS p FROM lineitem GROUP BY 1")
sparql("mode", 'SELECT ?g (AGG(agg:MODE, ?m) AS ?mode) WHERE { ?c :c_mktsegment ?g BIND(IF(STRENDS(?g, "G"), "yes", "no") AS ?m) } GROUP BY ?g', "SELECT c_mktsegment AS g, CASE WHEN c_mktsegment LIKE '%G' THEN 'yes' ELSE 'no' END AS mode FROM customer GROUP BY 1")
sparql("topk", "SELECT ?r (AGG(agg:TOPK, ?k; K=3) AS ?top) WHERE { ?x :n_region/:r_name ?r ; :n_nationkey ?k } GROUP BY ?r",
    "SELECT r_name AS r, string_agg(n_nationkey::VARCHAR, ' ' ORDER BY n_nationkey DESC) AS top FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rn FROM nation) JOIN region ON n_regionkey = r_regionkey WHERE rn <= 3 GROUP BY 1")
sparql("first_last", "SELECT ?g (AGG(agg:FIRST, ?n) AS ?first) (AGG(agg:LAST, ?n) AS ?last) WHERE { SELECT ?g ?n WHERE { ?c :c_mktsegment ?g ; :c_name ?n ; :c_custkey ?k } ORDER BY DESC(?k) } GROUP BY ?g", "SELECT c_mktsegment AS g, arg_max(c_name, c_custkey) AS first, arg_min(c_name, c_custkey) AS last FROM customer GROUP BY 1")
# functions
_N = "SELECT ?k {0} WHERE {{ ?x :p_partkey ?k ; :p_name ?n ; :p_type ?t ; :p_brand ?b ; :p_retailprice ?p ; :p_size ?z }}"


def scalar(name: str, expr: str, sql: str) -> None:
    sparql(name, _N.format(f"({expr} AS ?v)"), f"SELECT p_partkey AS k, {sql} AS v FROM part")


for _name, _e, _s in (
    ("str_strlen", "STRLEN(?n)", "length(p_name)::BIGINT"), ("str_substr", "SUBSTR(?n, 3, 4)", "substr(p_name, 3, 4)"), ("str_ucase", "UCASE(?n)", "upper(p_name)"), ("str_lcase", "LCASE(?b)", "lower(p_brand)"),
    ("str_contains", 'CONTAINS(?t, "STEEL")', "contains(p_type, 'STEEL')"), ("str_starts", 'STRSTARTS(?t, "PROMO")', "starts_with(p_type, 'PROMO')"), ("str_ends", 'STRENDS(?t, "TIN")', "suffix(p_type, 'TIN')"),
    ("str_before", 'STRBEFORE(?t, " ")', "CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, 1, strpos(p_type, ' ') - 1) ELSE '' END"), ("str_after", 'STRAFTER(?b, "#")', "CASE WHEN strpos(p_brand, '#') > 0 THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END"),
    ("str_replace", 'REPLACE(?n, "[aeiou]", "*")', "regexp_replace(p_name, '[aeiou]', '*', 'g')"), ("str_regex", 'REGEX(?t, "^p.*tin$", "i")', "regexp_matches(p_type, '(?i)^p.*tin$')"), ("str_encode", "ENCODE_FOR_URI(?b)", "replace(p_brand, '#', '%23')"),
    ("str_concat", 'CONCAT(?b, "/", ?n)', "p_brand || '/' || p_name"), ("num_abs", "ABS(25 - ?z)", "abs(25 - p_size)::BIGINT"), ("num_ceil", "CEIL(?p)", "ceil(p_retailprice)"), ("num_floor", "FLOOR(?p)", "floor(p_retailprice)"),
    ("num_round", "ROUND(?p)", "floor(p_retailprice + 0.5)"), ("num_arith", "(?z * 2 + 1) * ?p / 4", "(p_size * 2 + 1) * p_retailprice / 4"), ("num_neg", "-?z", "-p_size::BIGINT"), ("num_int_div", "xsd:double(?z / 8)", "p_size / 8.0::DOUBLE"),
    ("hash_md5", "MD5(?n)", "md5(p_name)"), ("hash_sha1", "SHA1(?n)", "sha1(p_name)"), ("hash_sha256", "SHA256(?n)", "sha256(p_name)"), ("cond_if", 'IF(?z > 25, "big", "small")', "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    ("cond_coalesce", "COALESCE(?nothing, xsd:integer(?n), ?z)", "p_size::BIGINT"), ("cast_int", "xsd:integer(?p)", "trunc(p_retailprice)::BIGINT"), ("cast_string", "xsd:string(?z)", "p_size::VARCHAR"), ("cast_double", "xsd:double(?z)", "p_size::DOUBLE"),
    ("cast_boolean", "xsd:boolean(?z - 7)", "p_size <> 7"), ("term_isnumeric", "isNumeric(?n)", "false"), ("term_isiri", "isIRI(?x)", "true"), ("term_datatype", "DATATYPE(?z)", "'http://www.w3.org/2001/XMLSchema#integer'"), ("term_str", "STR(?x)", "'$Bpart/' || p_partkey"),
    ("term_iri", 'IRI(CONCAT("http://x.test/", STR(?z)))', "'http://x.test/' || p_size"), ("term_sameterm", "sameTerm(?z, 7)", "p_size = 7"), ("term_bound", "BOUND(?nothing)", "false"), ("term_strdt", "xsd:integer(STRDT(STR(?z), xsd:integer))", "p_size::BIGINT"),
    ("term_strlang", 'LANG(STRLANG(?n, "en"))', "'en'"), ("lang_matches", 'LANGMATCHES("en-GB", "en")', "true"), ("hash_sha384", "STRLEN(SHA384(?n))", "96::BIGINT"), ("hash_sha512", "STRLEN(SHA512(?n))", "128::BIGINT"), ("term_triple", "isTRIPLE(TRIPLE(?x, :p, ?z))", "true"),
    ("term_subject", "SUBJECT(TRIPLE(?x, :p, ?z)) = ?x", "true"), ("uuid_shape", 'REGEX(STR(UUID()), "^urn:uuid:[0-9a-f-]{36}$")', "true"), ("rand_range", "RAND() < 1", "true"), ("bnode_fresh", "isBLANK(BNODE())", "true"), ("now_same", "NOW() = NOW()", "true"),
):
    scalar(_name, _e, _s)
for _name, _f, _s in (("year", "YEAR", "year"), ("month", "MONTH", "month"), ("day", "DAY", "day"), ("hours", "HOURS", "hour"), ("minutes", "MINUTES", "minute")):
    sparql(f"date_{_name}", f"SELECT ?k ({_f}(?d) AS ?v) WHERE {{ ?e :event_id ?k ; :ts ?d }}", f"SELECT event_id AS k, {_s}(ts)::BIGINT AS v FROM events")
sparql("date_seconds", "SELECT ?k (xsd:double(SECONDS(?d)) AS ?v) WHERE { ?e :event_id ?k ; :ts ?d }", "SELECT event_id AS k, (second(ts) + (microsecond(ts) % 1000000) / 1e6)::DOUBLE AS v FROM events")
sparql("date_compare", 'SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d FILTER(?d >= "1995-01-01T00:00:00"^^xsd:dateTime && ?d < "1996-01-01T00:00:00"^^xsd:dateTime) }', "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'")
sparql("date_tz", "SELECT (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d FILTER(TZ(?d) = \"\") }", "SELECT count(*)::BIGINT AS n FROM orders")
sparql("lang_tag", "SELECT ?l (COUNT(*) AS ?n) WHERE { ?d :text ?t BIND(LANG(?t) AS ?l) } GROUP BY ?l", "SELECT lang AS l, count(*)::BIGINT AS n FROM documents GROUP BY 1")
sparql("lang_filter", 'SELECT ?k (STRLEN(?t) AS ?n) WHERE { ?d :doc_id ?k ; :text ?t FILTER(LANGMATCHES(LANG(?t), "fr")) }', "SELECT doc_id AS k, length(text)::BIGINT AS n FROM documents WHERE lang = 'fr'")
# paths
sparql("path_seq", "SELECT ?n ?r WHERE { ?x :c_name ?n ; :c_nation/:n_region/:r_name ?r }", "SELECT c_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_alt", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?x (:c_nation|:s_nation)/:n_name ?n } GROUP BY ?n", "SELECT n_name AS n, count(*)::BIGINT AS k FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON x = n_nationkey GROUP BY 1")
sparql("path_inv", "SELECT ?r (COUNT(?c) AS ?k) WHERE { ?y :r_name ?r ; ^:n_region/^:c_nation ?c } GROUP BY ?r", "SELECT r_name AS r, count(*)::BIGINT AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
sparql("path_neg", "SELECT (COUNT(*) AS ?k) WHERE { ?x a :Nation ; !(:n_name|:n_region) ?v }", "SELECT 2 * count(*)::BIGINT AS k FROM nation")
sparql("path_opt", "SELECT ?a ?b WHERE { ?x :c_sponsor? ?y . ?x :c_custkey ?a . ?y :c_custkey ?b }", "SELECT c_custkey AS a, c_custkey AS b FROM customer UNION SELECT c_custkey, (c_custkey - 1) // 2 FROM customer WHERE c_custkey > 0")
_TREE = "WITH RECURSIVE e AS (SELECT c_custkey AS a, (c_custkey - 1) // 2 AS b FROM customer WHERE c_custkey > 0), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) "
sparql("path_plus", "SELECT ?a ?b WHERE { ?x :c_sponsor+ ?y . ?x :c_custkey ?a . ?y :c_custkey ?b }", _TREE + "SELECT a, b FROM r")
sparql("path_plus_const", f"SELECT ?a WHERE {{ ?x :c_sponsor+ <{BASE}customer/3> . ?x :c_custkey ?a }}", _TREE + "SELECT a FROM r WHERE b = 3")
sparql("path_star", f"SELECT ?b WHERE {{ <{BASE}customer/97> :c_sponsor* ?y . ?y :c_custkey ?b }}", _TREE + "SELECT b FROM r WHERE a = 97 UNION SELECT 97")
sparql("path_range", "SELECT ?a ?b WHERE { ?x :c_sponsor{2,3} ?y . ?x :c_custkey ?a . ?y :c_custkey ?b }", """WITH e AS (SELECT c_custkey AS a, (c_custkey - 1) // 2 AS b FROM customer WHERE c_custkey > 0), e2 AS (SELECT x.a, y.b FROM e AS x JOIN e AS y ON x.b = y.a)
    SELECT a, b FROM e2 UNION SELECT x.a, y.b FROM e2 AS x JOIN e AS y ON x.b = y.a""")  # fmt: skip


# queries that are not one SPARQL text
def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("$B", BASE)
        return f

    return keep


def _quads(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Mapped tables as quads."""
    from ..sources.relational import RelationalSource
    from .tables import MAPS

    maps = [m for m in MAPS if m.table in tables]
    return RelationalSource(spark, maps, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")).all_quads()


def _geo(spark: SparkSession, sf_dir: str):
    from ..dataset import Dataset

    return Dataset.of_quads(_quads(spark, sf_dir, "region", "nation"))


def _shown(df: DataFrame) -> DataFrame:
    from ..operators.projections import terms_text

    return terms_text(df).select("s", "p", "o", "g")


_GEO = """SELECT '$Bregion/' || r_regionkey AS s, '$Br_regionkey' AS p, r_regionkey::VARCHAR AS o FROM region UNION ALL SELECT '$Bregion/' || r_regionkey, '$Br_name', r_name FROM region
  UNION ALL SELECT '$Bregion/' || r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '$BRegion' FROM region
  UNION ALL SELECT '$Bnation/' || n_nationkey, '$Bn_nationkey', n_nationkey::VARCHAR FROM nation UNION ALL SELECT '$Bnation/' || n_nationkey, '$Bn_name', n_name FROM nation
  UNION ALL SELECT '$Bnation/' || n_nationkey, '$Bn_region', '$Bregion/' || n_regionkey FROM nation UNION ALL SELECT '$Bnation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '$BNation' FROM nation"""


@query("quads_scan", _GEO)
def quads_scan(spark, sf_dir):
    return _shown(_geo(spark, sf_dir).quads).select("s", "p", "o")


@query("quads_star_join", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def quads_star_join(spark, sf_dir):
    return _geo(spark, sf_dir).query(PREFIX + "SELECT ?n ?r WHERE { ?x a :Nation ; :n_name ?n ; :n_region ?y . ?y :r_name ?r }").df


@query("quads_aggregate", "SELECT r_name AS r, count(*)::BIGINT AS n, sum(n_nationkey)::BIGINT AS s FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def quads_aggregate(spark, sf_dir):
    return _geo(spark, sf_dir).query(PREFIX + "SELECT ?r (COUNT(*) AS ?n) (xsd:integer(SUM(?k)) AS ?s) WHERE { ?x :n_region/:r_name ?r ; :n_nationkey ?k } GROUP BY ?r").df


@query("match_pattern", "SELECT '$Bnation/' || n_nationkey AS s, '$Bn_name' AS p, n_name AS o FROM nation")
def match_pattern(spark, sf_dir):
    from ..terms import IRI

    return _shown(_geo(spark, sf_dir).match(p=IRI(BASE + "n_name"))).select("s", "p", "o")


@query("update_insert", "SELECT count(*)::BIGINT AS n FROM (SELECT 1 FROM region UNION ALL SELECT 1)")
def update_insert(spark, sf_dir):
    d = _geo(spark, sf_dir).update(PREFIX + 'INSERT DATA { :region\\/9 :r_name "ATLANTIS" }')
    return d.query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?x :r_name ?n }").df


@query("update_delete", "SELECT n_name AS n FROM nation WHERE n_nationkey <> 3")
def update_delete(spark, sf_dir):
    d = _geo(spark, sf_dir).update(PREFIX + "DELETE WHERE { ?x :n_nationkey 3 ; :n_name ?n }")
    return d.query(PREFIX + "SELECT ?n WHERE { ?x :n_name ?n }").df


@query("update_modify", "SELECT lower(n_name) AS n, n_nationkey::BIGINT AS k FROM nation")
def update_modify(spark, sf_dir):
    d = _geo(spark, sf_dir).update(PREFIX + "DELETE { ?x :n_name ?n } INSERT { ?x :n_name ?m } WHERE { ?x :n_name ?n BIND(LCASE(?n) AS ?m) }")
    return d.query(PREFIX + "SELECT ?n (xsd:integer(?j) AS ?k) WHERE { ?x :n_name ?n ; :n_nationkey ?j }").df


@query("update_graph_mgmt", "SELECT g, n FROM (VALUES ('$Bg2', 75::BIGINT), ('$Bg3', 75::BIGINT)) AS t(g, n)")
def update_graph_mgmt(spark, sf_dir):
    text = "INSERT { GRAPH :g1 { ?x ?p ?o } } WHERE { ?x a :Nation ; ?p ?o FILTER(?p != :n_name) } ; COPY :g1 TO :g2 ; ADD :g2 TO :g3 ; MOVE :g1 TO :g4 ; CLEAR GRAPH :g4 ; DROP SILENT GRAPH :g5"
    return _geo(spark, sf_dir).update(PREFIX + text).query(PREFIX + "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x ?p ?o } } GROUP BY ?g").df


def _with_schema(spark, sf_dir, turtle: str):
    from ..dataset import Dataset
    from ..sources.quads import SCHEMA
    from ..sources.readers import parse

    head = f"@prefix : <{BASE}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
    more = spark.createDataFrame(parse(head + turtle, "turtle"), SCHEMA)
    return Dataset.of_quads(_quads(spark, sf_dir, "region", "nation").unionByName(more)), more


@query("rdfs_subclass", "SELECT '$Bnation/' || n_nationkey AS x FROM nation UNION ALL SELECT '$Bregion/' || r_regionkey FROM region")
def rdfs_subclass(spark, sf_dir):
    d, _ = _with_schema(spark, sf_dir, ":Nation rdfs:subClassOf :Area . :Area rdfs:subClassOf :Place . :Region rdfs:subClassOf :Place .")
    return d.materialise("RDFS").query(PREFIX + "SELECT ?x WHERE { ?x a :Place }").df


@query("rdfs_domain_range", "SELECT DISTINCT '$Bregion/' || n_regionkey AS x FROM nation")
def rdfs_domain_range(spark, sf_dir):
    d, _ = _with_schema(spark, sf_dir, ":n_region rdfs:range :Whole ; rdfs:domain :Part ; rdfs:subPropertyOf :within .")
    return d.materialise("RDFS").query(PREFIX + "SELECT DISTINCT ?x WHERE { ?y a :Part ; :within ?x . ?x a :Whole }").df


@query("owl_transitive", "SELECT '$Bnation/' || n_nationkey AS x FROM nation UNION ALL SELECT '$Bregion/' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def owl_transitive(spark, sf_dir):
    d, _ = _with_schema(spark, sf_dir, ":n_region rdfs:subPropertyOf :within . :within a owl:TransitiveProperty . " + " ".join(f"<{BASE}region/{i}> :within :world ." for i in range(5)))
    return d.materialise("OWL-RL").query(PREFIX + "SELECT ?x WHERE { ?x :within :world FILTER EXISTS { { ?x a :Nation } UNION { ?y :n_region ?x } } }").df


@query("owl_inverse", "SELECT '$Bregion/' || n_regionkey AS r, '$Bnation/' || n_nationkey AS n FROM nation")
def owl_inverse(spark, sf_dir):
    d, _ = _with_schema(spark, sf_dir, ":n_region owl:inverseOf :has .")
    return d.materialise("OWL-RL").query(PREFIX + "SELECT ?r ?n WHERE { ?r :has ?n }").df


@query("owl_sameas", "SELECT n_name AS n FROM nation WHERE n_nationkey = 5")
def owl_sameas(spark, sf_dir):
    d, _ = _with_schema(spark, sf_dir, f":code a owl:InverseFunctionalProperty . <{BASE}nation/5> :code 'E' . :other :code 'E' .")
    return d.materialise("OWL-RL").query(PREFIX + "SELECT ?n WHERE { :other :n_name ?n }").df


@query("owl_clash", "SELECT 'cax-dw' AS rule, 5::BIGINT AS n")
def owl_clash(spark, sf_dir):
    from pyspark.sql import functions as F

    d, _ = _with_schema(spark, sf_dir, ":Region owl:disjointWith :Whole . " + " ".join(f"<{BASE}region/{i}> a :Whole ." for i in range(5)))
    return d.consistency().groupBy("rule").agg(F.count("*").alias("n"))


@query("owl_chain", "SELECT count(*)::BIGINT AS n FROM nation")
def owl_chain(spark, sf_dir):
    d, _ = _with_schema(spark, sf_dir, ":inWorld owl:propertyChainAxiom (:n_region :of) . " + " ".join(f"<{BASE}region/{i}> :of :world ." for i in range(5)))
    return d.materialise("OWL-RL").query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?x :inWorld :world }").df


@query("datalog_rules", "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def datalog_rules(spark, sf_dir):
    d = _geo(spark, sf_dir).materialise("Simple", [f"?x <{BASE}n_region> ?r . ?y <{BASE}n_region> ?r . ?x != ?y -> ?x <{BASE}near> ?y"])
    return d.query(PREFIX + "SELECT ?a ?b WHERE { ?x :near ?y ; :n_name ?a . ?y :n_name ?b }").df


def _shacl(name: str, shape: str, sql: str, data: str = "") -> None:
    def run(spark, sf_dir):
        from pyspark.sql import functions as F

        d, shapes = _with_schema(spark, sf_dir, data + shape)
        return d.validate(shapes).select(F.substr("focus", F.lit(2)).alias("focus"), "component")

    QUERIES["shacl_" + name] = run
    ORACLES["shacl_" + name] = sql.replace("$B", BASE)


_N1 = "SELECT '$Bnation/' || n_nationkey AS focus, '{}' AS component FROM nation WHERE {}"
_shacl("mincount", ":S a sh:NodeShape ; sh:targetClass :Nation ; sh:property [ sh:path :capital ; sh:minCount 1 ] .", _N1.format("MinCount", "true"))
_shacl("maxcount", ":S a sh:NodeShape ; sh:targetClass :Region ; sh:property [ sh:path [ sh:inversePath :n_region ] ; sh:maxCount 4 ] .", "SELECT '$Bregion/' || n_regionkey AS focus, 'MaxCount' AS component FROM nation GROUP BY n_regionkey HAVING count(*) > 4")
_shacl("datatype", ":S sh:targetClass :Nation ; sh:property [ sh:path :n_name ; sh:datatype xsd:integer ] .", _N1.format("Datatype", "true"))
_shacl("pattern", ":S sh:targetClass :Nation ; sh:property [ sh:path :n_name ; sh:pattern '^[A-M]' ] .", _N1.format("Pattern", "NOT regexp_matches(n_name, '^[A-M]')"))
_shacl("range", ":S sh:targetClass :Nation ; sh:property [ sh:path :n_nationkey ; sh:minInclusive 3 ; sh:maxExclusive 20 ] .", _N1.format("MinInclusive", "n_nationkey < 3") + " UNION ALL " + _N1.format("MaxExclusive", "n_nationkey >= 20"))
_shacl("class", ":S sh:targetClass :Nation ; sh:property [ sh:path :n_region ; sh:class :Nation ] .", _N1.format("Class", "true"))
_shacl("in", f":S sh:targetSubjectsOf :n_region ; sh:property [ sh:path :n_region ; sh:in ( <{BASE}region/0> <{BASE}region/1> ) ] .", _N1.format("In", "n_regionkey > 1"))
_shacl("unique_lang", f":S sh:targetNode <{BASE}nation/1>, <{BASE}nation/2> ; sh:property [ sh:path :label ; sh:uniqueLang true ] .", _N1.format("UniqueLang", "n_nationkey = 1"), f'<{BASE}nation/1> :label "a"@en, "b"@en . <{BASE}nation/2> :label "a"@en, "b"@fr . ')
_shacl("closed", ":S sh:targetClass :Region ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path :r_name ] .", "SELECT '$Bregion/' || r_regionkey AS focus, 'Closed' AS component FROM region")
_shacl("logic", ":S sh:targetClass :Nation ; sh:or ( [ sh:property [ sh:path :n_nationkey ; sh:maxInclusive 5 ] ] [ sh:property [ sh:path :n_nationkey ; sh:minInclusive 20 ] ] ) .", _N1.format("Or", "n_nationkey > 5 AND n_nationkey < 20"))
_shacl("not", f":S sh:targetClass :Nation ; sh:not [ sh:property [ sh:path :n_region ; sh:hasValue <{BASE}region/2> ] ] .", _N1.format("Not", "n_regionkey = 2"))
_shacl("sparql", f':S sh:targetClass :Nation ; sh:sparql [ sh:select "SELECT $this ?value WHERE {{ $this <{BASE}n_region> ?value . ?value <{BASE}r_name> \'ASIA\' }}" ] .', "SELECT '$Bnation/' || n_nationkey AS focus, 'SPARQL' AS component FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")


@query("rdf12_reifier", "SELECT n_name AS n, 'sure' AS c FROM nation WHERE n_nationkey < 2")
def rdf12_reifier(spark, sf_dir):
    from ..dataset import Dataset
    from ..sources.quads import SCHEMA
    from ..sources.readers import parse

    text = f"@prefix : <{BASE}> . " + " ".join(f"<{BASE}nation/{i}> :n_region <{BASE}region/{i}> ~ :r{i} {{| :certainty 'sure' |}} ." for i in range(2))
    d = Dataset.of_quads(_quads(spark, sf_dir, "region", "nation").unionByName(spark.createDataFrame(parse(text, "turtle"), SCHEMA)))
    return d.query(PREFIX + "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> SELECT ?n ?c WHERE { ?r rdf:reifies <<( ?x :n_region ?y )>> ; :certainty ?c . ?x :n_name ?n }").df


@query("list_functions", "SELECT '$Blists/' || o_custkey AS list, count(*)::BIGINT AS n, (min(o_orderkey))::VARCHAR AS first FROM orders GROUP BY o_custkey")
def list_functions(spark, sf_dir):
    return _order_lists(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _order_lists(orders):
    """The lists that customers' orders make, with their length and first item."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..operators import projections as P

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    cell = lambda i: F.when(i == 0, F.concat(F.lit(f"I{BASE}lists/"), "o_custkey")).otherwise(F.concat(F.lit("Bc"), "o_custkey", F.lit("_"), i.cast("string")))
    n = orders.select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    pairs = F.array(
        F.struct(F.lit(f"I{rdf}first").alias("p"), F.concat(F.lit("Lx:integer\x1f\x1f"), "o_orderkey").alias("o")),
        F.struct(F.lit(f"I{rdf}rest").alias("p"), F.when(F.col("i") + 1 == F.col("n"), F.lit(f"I{rdf}nil")).otherwise(cell(F.col("i") + 1)).alias("o")),
    )
    quads = n.select(cell(F.col("i")).alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o", F.lit(None).cast("string").alias("g"))
    found = P.lists(quads).where(F.col("list").startswith("I"))
    fn = P.list_functions(F.col("items"))
    return found.select(F.substr("list", F.lit(2)).alias("list"), fn["listLength"].alias("n"), F.get(F.split(fn["listGet"](F.lit(0)), "\x1f"), F.lit(2)).alias("first"))


@query("void_stats", """SELECT 'triples' AS statistic, '' AS subject, count(*)::BIGINT AS n FROM (%s) UNION ALL SELECT 'propertyPartition', p, count(*) FROM (%s) GROUP BY p
    UNION ALL SELECT 'classPartition', o, count(*) FROM (%s) WHERE p LIKE '%%#type' GROUP BY o""" % (_GEO, _GEO, _GEO))
def void_stats(spark, sf_dir):
    from ..operators.projections import void

    return void(_geo(spark, sf_dir).quads).where("statistic IN ('triples', 'propertyPartition', 'classPartition')")


@query("lpg_nodes", "SELECT '$BRegion' AS label, 5::BIGINT AS nodes, 10::BIGINT AS properties UNION ALL SELECT '$BNation', 25, 50")
def lpg_nodes(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.projections import lpg_nodes as nodes

    n = nodes(_geo(spark, sf_dir).quads)
    return n.groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("nodes"), F.sum(F.size("properties")).alias("properties"))


@query("lpg_edges", "SELECT '$Bnation/' || n_nationkey AS source, '$Bn_region' AS label, '$Bregion/' || n_regionkey AS target FROM nation")
def lpg_edges(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.projections import lpg_edges as edges

    return edges(_geo(spark, sf_dir).quads).select(F.substr("source", F.lit(2)).alias("source"), "label", F.substr("target", F.lit(2)).alias("target"))


@query("embedding_topk", """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def embedding_topk(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.projections import top_k

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return top_k(e, q).select("vec_id", F.round("score", 6).alias("score"))


@query("table_function", "SELECT n_name AS n, n_nationkey * 10::BIGINT AS v FROM nation WHERE n_nationkey < 3")
def table_function(spark, sf_dir):
    rows = [(f"I{BASE}nation/{i}", f"Lx:integer\x1f\x1f{i * 10}") for i in range(3)]
    d = dataset(spark, sf_dir, relations={BASE + "score": spark.createDataFrame(rows, "a string, b string")})
    return d.query(PREFIX + "SELECT ?n (xsd:integer(?s) AS ?v) WHERE { ?x :n_name ?n . ?x :score ?s }").df


@query("udf", "SELECT p_partkey AS k, reverse(p_name) AS v FROM part")
def udf(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions.values import Val, as_string

    d = dataset(spark, sf_dir, functions={BASE + "backwards": lambda a: Val("str", F.reverse(as_string(a)))})
    return d.query(PREFIX + "SELECT ?k (:backwards(?n) AS ?v) WHERE { ?x :p_partkey ?k ; :p_name ?n }").df


@query("custom_agg", "SELECT p_brand AS b, exp(avg(ln(p_retailprice))) AS v FROM part GROUP BY 1")
def custom_agg(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions.values import as_double

    d = dataset(spark, sf_dir, aggregates={BASE + "geomean": lambda args, a: ("dbl", F.exp(F.avg(F.log(as_double(args[0])))), None)})
    return d.query(PREFIX + "SELECT ?b (AGG(:geomean, ?p) AS ?v) WHERE { ?x :p_brand ?b ; :p_retailprice ?p } GROUP BY ?b").df


@query("service_seam", "SELECT n_name AS n, 'remote' AS w FROM nation WHERE n_nationkey = 4")
def service_seam(spark, sf_dir):
    from ..terms import IRI, Literal

    d = dataset(spark, sf_dir, service=lambda endpoint, text, names: [{"x": IRI(BASE + "nation/4"), "w": Literal("remote")}])
    return d.query(PREFIX + "SELECT ?n ?w WHERE { ?x :n_name ?n SERVICE <http://far.test/> { ?x :w ?w } }").df


@query("prebinding", "SELECT n_name AS n FROM nation WHERE n_regionkey = 2")
def prebinding(spark, sf_dir):
    from ..terms import IRI

    return dataset(spark, sf_dir).query(PREFIX + "SELECT ?n WHERE { ?x :n_region ?r ; :n_name ?n }", bindings={"r": IRI(BASE + "region/2")}).df


@query("skolem_round_trip", _GEO)
def skolem_round_trip(spark, sf_dir):
    from ..operators import projections as P

    q = _geo(spark, sf_dir).quads
    return _shown(P.deskolemize(P.skolemize(q, "http://auth.test"), "http://auth.test")).select("s", "p", "o")


@query("dataset_diff", "SELECT 'left' AS side, count(*)::BIGINT AS n FROM nation")
def dataset_diff(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators import projections as P

    q = _geo(spark, sf_dir).quads
    return P.difference(q, q.where(F.col("p") != f"I{BASE}n_name")).groupBy("side").agg(F.count("*").alias("n"))


@query("canonical_blanks", "SELECT true AS same")
def canonical_blanks(spark, sf_dir):
    from ..operators import projections as P
    from ..sources.quads import SCHEMA
    from ..sources.readers import parse

    text = "@prefix : <http://t.test/> . _:a :p _:b . _:b :q 'x', _:c . _:c :q _:a . [] :r _:c ."
    a, b = (spark.createDataFrame(parse(text.replace("_:a", x), "turtle", x[2:]), SCHEMA) for x in ("_:one", "_:two"))
    return spark.createDataFrame([(P.isomorphic(a, b),)], "same boolean")


@query("columnar_round_trip", _GEO)
def columnar_round_trip(spark, sf_dir):
    import uuid

    from ..sources.columnar import read_tables, write_tables
    from ..storage import workspace

    path = f"{workspace(spark)}/tables-{uuid.uuid4().hex}"
    write_tables(_geo(spark, sf_dir).quads, path)
    return _shown(read_tables(spark, path)).select("s", "p", "o")


@query("ntriples_round_trip", _GEO)
def ntriples_round_trip(spark, sf_dir):
    import uuid

    from ..sources.readers import read
    from ..sources.writers import write
    from ..storage import workspace

    path = f"{workspace(spark)}/lines-{uuid.uuid4().hex}"
    write(_geo(spark, sf_dir).quads, path, "nquads")
    return _shown(read(spark, path, "nquads")).select("s", "p", "o")


# quads of customers and their orders, written by predicate
def _shop(spark, sf_dir, turtle: str = ""):
    from ..dataset import Dataset
    from ..sources.quads import SCHEMA
    from ..sources.readers import parse

    quads = _quads(spark, sf_dir, "customer", "orders", "nation")
    if turtle:
        head = f"@prefix : <{BASE}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . "
        quads = quads.unionByName(spark.createDataFrame(parse(head + turtle, "turtle"), SCHEMA))
    return Dataset.of_quads(quads).stored()


def _turtle(spark, text: str):
    from ..dataset import Dataset
    from ..sources.quads import SCHEMA
    from ..sources.readers import parse

    head = f"@prefix : <{BASE}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
    return Dataset.of_quads(spark.createDataFrame(parse(head + text, "turtle"), SCHEMA))


@query("shop_star_join", "SELECT c_mktsegment AS g, n_name AS n, count(*)::BIGINT AS k, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def shop_star_join(spark, sf_dir):
    from pyspark.sql import functions as F

    d = _shop(spark, sf_dir).query(PREFIX + "SELECT ?g ?n (COUNT(*) AS ?k) (xsd:double(SUM(?p)) AS ?t) WHERE { ?o :o_customer ?c ; :o_totalprice ?p . ?c :c_mktsegment ?g ; :c_nation/:n_name ?n } GROUP BY ?g ?n").df
    return d.select("g", "n", "k", F.round(F.col("t").cast("double"), 2).alias("t"))


@query("shop_update_modify", "SELECT lower(c_mktsegment) AS g, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def shop_update_modify(spark, sf_dir):
    d = _shop(spark, sf_dir).update(PREFIX + "DELETE { ?x :c_mktsegment ?n } INSERT { ?x :c_mktsegment ?m } WHERE { ?x :c_mktsegment ?n BIND(LCASE(?n) AS ?m) }")
    return d.query(PREFIX + "SELECT ?g (COUNT(*) AS ?n) WHERE { ?x :c_mktsegment ?g } GROUP BY ?g").df


@query("shop_update_delete", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def shop_update_delete(spark, sf_dir):
    d = _shop(spark, sf_dir).update(PREFIX + "DELETE { ?o ?p ?v } WHERE { ?o :o_customer/:c_acctbal ?b ; ?p ?v FILTER(?b < 0) }")
    return d.query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?o a :Order }").df


@query("shop_rules", "SELECT n_name AS n, count(DISTINCT c_custkey)::BIGINT AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def shop_rules(spark, sf_dir):
    d = _shop(spark, sf_dir).materialise("Simple", [f"?o <{BASE}o_customer> ?c . ?c <{BASE}c_nation> ?n -> ?n <{BASE}buyer> ?c"])
    return d.query(PREFIX + "SELECT ?n (COUNT(*) AS ?k) WHERE { ?x :buyer ?c ; :n_name ?n } GROUP BY ?n").df


@query("shop_rules_negation", "SELECT c_custkey::BIGINT AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def shop_rules_negation(spark, sf_dir):
    rules = [f"?c <{BASE}c_nation> ?n . not ?c <{BASE}buys> ?n -> ?n <{BASE}idle> ?c", f"?o <{BASE}o_customer> ?c . ?c <{BASE}c_nation> ?n -> ?c <{BASE}buys> ?n"]
    d = _shop(spark, sf_dir).materialise("Simple", rules)
    return d.query(PREFIX + "SELECT (xsd:integer(?j) AS ?k) WHERE { ?n :idle ?c . ?c :c_custkey ?j }").df


@query("shop_rdfs", "SELECT (SELECT count(*) FROM customer)::BIGINT + (SELECT count(*) FROM orders) AS n")
def shop_rdfs(spark, sf_dir):
    d = _shop(spark, sf_dir, ":Customer rdfs:subClassOf :Thing . :o_customer rdfs:domain :Thing .").materialise("RDFS")
    return d.query(PREFIX + "SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x a :Thing }").df


@query("shop_owl_inverse", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_custkey IS NOT NULL")
def shop_owl_inverse(spark, sf_dir):
    d = _shop(spark, sf_dir, ":o_customer owl:inverseOf :ordered .").materialise("OWL-RL")
    return d.query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?c :ordered ?o }").df


@query("shop_shacl", """SELECT '$Bcustomer/' || o_custkey AS focus, 'MaxCount' AS component FROM orders GROUP BY o_custkey HAVING count(*) > 15
    UNION ALL SELECT '$Bcustomer/' || c_custkey, 'MinInclusive' FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT '$Bcustomer/' || c_custkey, 'In' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def shop_shacl(spark, sf_dir):
    from pyspark.sql import functions as F

    shapes = _turtle(spark, """:S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path [ sh:inversePath :o_customer ] ; sh:maxCount 15 ] ,
      [ sh:path :c_acctbal ; sh:minInclusive 0.0 ] , [ sh:path :c_mktsegment ; sh:in ( "BUILDING" "MACHINERY" ) ] .""")
    return _shop(spark, sf_dir).validate(shapes).select(F.substr("focus", F.lit(2)).alias("focus"), "component")


@query("shop_shacl_rule", "SELECT count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def shop_shacl_rule(spark, sf_dir):
    from ..dataset import Dataset
    from ..operators import shapes as S

    rules = _turtle(spark, f""":S a sh:NodeShape ; sh:targetClass :Customer ; sh:rule [ a sh:SPARQLRule ; sh:prefixes :names ; sh:condition [ sh:property [ sh:path :c_mktsegment ; sh:hasValue "BUILDING" ] ] ;
      sh:construct "CONSTRUCT {{ $this t:large ?o }} WHERE {{ ?o t:o_customer $this ; t:o_totalprice ?p FILTER(?p > 200000) }}" ] .
      :names sh:declare [ sh:prefix "t" ; sh:namespace "{BASE}" ] .""")
    return Dataset.of_quads(S.rules(_shop(spark, sf_dir), rules)).query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?c :large ?o }").df


@query("shop_void", " UNION ALL ".join(f"SELECT 'propertyPartition' AS statistic, '$B{c}' AS subject, count({c})::BIGINT AS n FROM {t}" for t, c in (("customer", "c_custkey"), ("customer", "c_mktsegment"), ("orders", "o_orderkey"), ("orders", "o_totalprice"), ("orders", "o_orderstatus")))
    + " UNION ALL SELECT 'classPartition', '$BOrder', count(*) FROM orders UNION ALL SELECT 'classPartition', '$BCustomer', count(*) FROM customer UNION ALL SELECT 'distinctSubjects', '', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)")
def shop_void(spark, sf_dir):
    from ..operators.projections import void

    kept = [BASE + x for x in ("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice", "o_orderstatus", "Order", "Customer")]
    found = void(_shop(spark, sf_dir).quads)
    return found.where(found.subject.isin(kept) | (found.statistic == "distinctSubjects"))
