"""Registered queries over governed tables: masks, denials and the relational
constructs a reader may use on them, with their SQL.

The statements are ordinary Spark SQL on governed views: masks are Column
expressions in a projection, so Catalyst prunes denied columns and pushes
filters on clear ones to the scan. The comparison SQL runs the same statement
on the masks written out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.functions import masks
from quillgate.operators import policy
from quillgate.operators.policy import Rule
from quillgate.sources import catalog_file
from quillgate.sources.tables import table

SALT = "fixture-salt"
POLICY = {
    "customer": {"c_name": "auto", "c_acctbal": "deny"},
    "orders": {"o_orderdate": "generalize_date"},
    "supplier": {"s_name": "auto", "s_acctbal": "auto"},
    "events": {"user_id": "auto"},
    "lineitem": {}, "part": {}, "nation": {}, "region": {},
    "contacts": {"email": "auto", "phone": "auto", "c_name": "fixed_string", "note": "null"},
}

# customer_report's columns are copies of customer's and inherit their rules; customer_raw is deprecated in favour of customer.
CATALOG = """
datasets:
  - name: main.customer
    certified: true
    columns: [{name: c_custkey, type: BIGINT}, {name: c_name, tags: [pii]}, {name: c_nationkey, type: INT}, {name: c_acctbal, type: DOUBLE, terms: [classification.ssn]}, {name: c_mktsegment}]
  - name: main.customer_raw
    deprecated: true
    replaced_by: main.customer
    columns: [{name: c_custkey, type: BIGINT}, {name: c_name, tags: [pii]}, {name: c_acctbal, type: DOUBLE, terms: [classification.ssn]}]
  - name: main.customer_report
    columns: [{name: c_custkey, type: BIGINT, derives_from: [main.customer.c_custkey]}, {name: contact, derives_from: [main.customer.c_name]}, {name: balance, type: DOUBLE, derives_from: [main.customer.c_name, main.customer.c_acctbal]}]
"""
RULES = [Rule("pii", "mask", "auto", tag="pii"), Rule("ssn", "deny", term="classification.ssn"), Rule("old", "substitute_certified", lifecycle="DEPRECATED")]


def catalog_policy(spark: SparkSession, dataset: str) -> dict[str, str]:
    """{column: strategy or 'deny'} of a data set of CATALOG, inherited rules included."""
    t = catalog_file.load(spark, CATALOG)
    rows = policy.outcomes(t["columns"], t["column_lineage"], RULES).where(F.col("dataset") == dataset).collect()  # a row per column of one data set
    return {r.column: r.strategy if r.action == "mask" else "deny" for r in rows if r.action in ("mask", "deny")}


def effective_table(spark: SparkSession, dataset: str, columns: list[str]) -> str:
    """The table a read of ``dataset`` really goes to: a certified substitute that has all the columns."""
    t = catalog_file.load(spark, CATALOG)
    urn = t["datasets"].where(F.col("name") == dataset).first().urn
    have = t["columns"].groupBy(F.col("dataset_urn").alias("substitute")).agg(F.collect_set(F.lower("column")).alias("columns"))
    picks = policy.substitutes(t["datasets"], t["lineage"]).join(have, "substitute")
    reads = spark.createDataFrame([(0, urn, c) for c in columns], "request int, dataset_urn string, column string")
    to = policy.redirected(reads, picks).first().effective_urn
    return t["datasets"].where(F.col("urn") == to).first().name.rpartition(".")[2]


def governed_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The governed form of every table of the policy."""
    customer = table(spark, d, "customer")
    derived = {
        "contacts": customer.select(
            "c_custkey", "c_name", F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@corp.com")).alias("email"),
            F.concat(F.lit("555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"), F.col("c_mktsegment").alias("note"),
        ),
    }
    return {n: masks.governed(derived[n] if n in derived else table(spark, d, n), p, SALT) for n, p in POLICY.items()}


def ruled_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The governed form of a table of CATALOG: redirected where deprecated, masked by own and inherited rules."""
    customer = table(spark, d, "customer")
    if name == "customer_report":
        df = customer.select("c_custkey", F.col("c_name").alias("contact"), F.col("c_acctbal").alias("balance"))
    else:
        name = effective_table(spark, f"main.{name}", ["c_custkey", "c_name", "c_acctbal"])
        df = table(spark, d, name)
    return masks.governed(df, catalog_policy(spark, f"main.{name}"), SALT)


_RAW = """
gv_customer AS (SELECT c_custkey, md5('fixture-salt' || c_name) c_name, c_nationkey, CAST(NULL AS DOUBLE) c_acctbal, c_mktsegment FROM customer),
gv_orders AS (SELECT * REPLACE (date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate) FROM orders),
gv_supplier AS (SELECT * REPLACE (md5('fixture-salt' || s_name) AS s_name, md5('fixture-salt' || s_acctbal::VARCHAR) AS s_acctbal) FROM supplier),
gv_events AS (SELECT * REPLACE (md5('fixture-salt' || user_id::VARCHAR) AS user_id) FROM events),
gv_lineitem AS (SELECT * FROM lineitem), gv_part AS (SELECT * FROM part), gv_nation AS (SELECT * FROM nation), gv_region AS (SELECT * FROM region),
gv_contacts AS (SELECT c_custkey, '***' c_name, left(lower(c_name), 1) || '***@corp.com' email, '***-' || right(lpad(c_custkey::VARCHAR, 7, '0'), 4) phone, CAST(NULL AS VARCHAR) note FROM customer),
gv_customer_report AS (SELECT c_custkey, md5('fixture-salt' || c_name) contact, CAST(NULL AS DOUBLE) balance FROM customer),
gv_customer_raw AS (SELECT * FROM gv_customer)
"""

# name: statement, valid in both engines.
STATEMENTS = {
    "mask_hash": "SELECT c_custkey, c_name FROM gv_customer",
    "mask_null": "SELECT c_custkey, note FROM gv_contacts",
    "mask_partial_email": "SELECT c_custkey, email FROM gv_contacts",
    "mask_partial_phone": "SELECT c_custkey, phone FROM gv_contacts",
    "mask_fixed_string": "SELECT c_custkey, c_name FROM gv_contacts",
    "mask_generalize_date": "SELECT o_orderkey, o_orderdate FROM gv_orders",
    "mask_auto": "SELECT s_suppkey, s_name, s_acctbal FROM gv_supplier",
    "deny_column_null": "SELECT c_custkey, c_acctbal FROM gv_customer",
    "star_expand": "SELECT * FROM gv_customer",
    "star_through_cte": "WITH t AS (SELECT * FROM gv_supplier) SELECT * FROM t",
    "subquery_mask": "SELECT x.n, x.k FROM (SELECT c_name AS n, c_custkey AS k, c_mktsegment AS s FROM gv_customer) x WHERE x.s <> 'BUILDING'",
    "hash_group_by": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_types FROM gv_events GROUP BY user_id",
    "hash_count_distinct": "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types FROM gv_events",
    "order_by_masked": "SELECT c_name, c_custkey, CAST(rank() OVER (ORDER BY c_name) AS BIGINT) AS place FROM gv_customer WHERE c_mktsegment = 'BUILDING'",
    "sort_limit_masked": "SELECT c_name, c_custkey FROM gv_customer ORDER BY c_name, c_custkey LIMIT 20",
    "lateral_join": "SELECT n.n_name, x.n, x.names FROM gv_nation n, LATERAL (SELECT count(*) AS n, count(DISTINCT c_name) AS names FROM gv_customer c WHERE c.c_nationkey = n.n_nationkey) x",
    "using_join": "SELECT c_custkey, c_name, contact FROM gv_customer JOIN gv_customer_report USING (c_custkey)",
    "natural_join": "SELECT c_custkey, c_mktsegment, contact FROM (SELECT c_custkey, c_mktsegment FROM gv_customer) NATURAL JOIN (SELECT c_custkey, contact FROM gv_customer_report)",
    "group_by_ordinal": "SELECT c_mktsegment, c_name IS NULL AS no_name, count(*) AS n FROM gv_customer GROUP BY 1, 2",
    "group_by_alias": "SELECT upper(c_mktsegment) AS segment, count(DISTINCT c_name) AS names FROM gv_customer GROUP BY segment",
    "values_join": "SELECT v.label, count(*) AS n, min(c.c_name) AS first_name FROM gv_customer c JOIN (VALUES ('BUILDING', 'b'), ('MACHINERY', 'm')) AS v(segment, label) ON v.segment = c.c_mktsegment GROUP BY v.label",
    "cte_shadows_table": "WITH gv_nation AS (SELECT c_nationkey AS k, c_name FROM gv_customer) SELECT k, count(DISTINCT c_name) AS names FROM gv_nation GROUP BY k",
    "recursive_cte": "WITH RECURSIVE t(k) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT k + 1 FROM t WHERE k < 24) SELECT t.k, count(c.c_name) AS n, count(DISTINCT c.c_name) AS names FROM t JOIN gv_customer c ON c.c_nationkey = t.k GROUP BY t.k",
    "union_mask": "SELECT c_name AS n FROM gv_customer UNION SELECT s_name FROM gv_supplier",
    "union_all_mask": "SELECT c_nationkey AS k, c_name AS n FROM gv_customer UNION ALL SELECT s_nationkey, s_name FROM gv_supplier",
    "intersect_mask": "SELECT c_name AS n FROM gv_customer INTERSECT SELECT contact FROM gv_customer_report",
    "except_mask": "SELECT c_nationkey AS k FROM gv_customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT s_nationkey FROM gv_supplier",
    "semi_exists": "SELECT c_custkey, c_name FROM gv_customer c WHERE EXISTS (SELECT 1 FROM gv_orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "in_subquery": "SELECT s_suppkey, s_name FROM gv_supplier WHERE s_suppkey IN (SELECT l_suppkey FROM gv_lineitem WHERE l_quantity > 49)",
    "anti_join": "SELECT c_custkey, c_name FROM gv_customer c WHERE NOT EXISTS (SELECT 1 FROM gv_orders o WHERE o.o_custkey = c.c_custkey)",
    "anti_exists": "SELECT c_custkey, c_name FROM gv_customer c WHERE NOT EXISTS (SELECT 1 FROM gv_orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "except_pairs": "SELECT c_nationkey AS k, c_mktsegment AS s FROM gv_customer EXCEPT SELECT s_nationkey, 'BUILDING' FROM gv_supplier",
    "self_join": "SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_name FROM gv_supplier a JOIN gv_supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "corr_scalar": "SELECT c_custkey, c_name, (SELECT max(o_totalprice) FROM gv_orders o WHERE o.o_custkey = c.c_custkey) AS top_price FROM gv_customer c",
    "case_mask": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'other' END AS n FROM gv_customer",
    "coalesce_mask": "SELECT c_custkey, coalesce(c_acctbal, -1.0) AS b FROM gv_customer",
    "concat_mask": "SELECT s_suppkey, upper(s_name) || '/' || length(s_name) AS n FROM gv_supplier",
    "window_row_number": "SELECT c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS BIGINT) AS rn FROM gv_customer",
    "named_window": "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, count(*) OVER w AS n FROM gv_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)",
    "rollup_clean": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM gv_orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_clean": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM gv_lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets_clean": "SELECT p_brand, p_type, count(*) AS n FROM gv_part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "having_clean": "SELECT o_custkey, count(*) AS n FROM gv_orders GROUP BY o_custkey HAVING count(*) > 15",
    "filter_agg_clean": "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n, count(c_name) AS names FROM gv_customer GROUP BY c_nationkey",
    "distinct_mask": "SELECT DISTINCT user_id, event_type FROM gv_events",
    "transform_predicate": "SELECT c_custkey FROM gv_customer WHERE c_name LIKE 'a%'",
    "substitute_join": "SELECT c.c_name, c.c_acctbal, o.o_totalprice, o.o_orderkey FROM gv_customer_raw c JOIN gv_orders o ON o.o_custkey = c.c_custkey",
    "substitute_read": "SELECT c_custkey, c_name, c_acctbal FROM gv_customer_raw",
    "lineage_inherited_mask": "SELECT c_custkey, contact FROM gv_customer_report",
    "lineage_inherited_deny": "SELECT c_custkey, balance FROM gv_customer_report",
    "month_revenue": "SELECT o.o_orderdate, n.n_name, count(*) AS n_lines, CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM gv_lineitem l JOIN gv_orders o ON l.l_orderkey = o.o_orderkey JOIN gv_customer c ON c.c_custkey = o.o_custkey JOIN gv_nation n ON n.n_nationkey = c.c_nationkey GROUP BY o.o_orderdate, n.n_name",
    "raw_monitor": "SELECT c_custkey, c_name, c_acctbal FROM customer",
}


def _query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        if name == "raw_monitor":  # monitor mode: nothing masked
            table(spark, d, "customer").createOrReplaceTempView("customer")
        for n, df in governed_tables(spark, d).items():
            if f"gv_{n}" in STATEMENTS[name]:
                df.createOrReplaceTempView(f"gv_{n}")
        for n in ("customer_report", "customer_raw"):
            if f"gv_{n}" in STATEMENTS[name]:
                ruled_table(spark, d, n).createOrReplaceTempView(f"gv_{n}")
        return spark.sql(STATEMENTS[name])

    run.__name__ = name
    return run


def mask_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Values of each masked column that lack the shape of their mask, over all rows."""
    return masks.misshapen(governed_tables(spark, d)["contacts"], {"email": "partial_email", "phone": "partial_phone", "c_name": "fixed_string"})


def mask_shapes_raw(spark: SparkSession, d: str) -> DataFrame:
    """The same check on the values before masking, which must fail it."""
    raw = table(spark, d, "customer").select(F.concat("c_name", F.lit("@corp.com")).alias("email"), F.when(F.col("c_custkey") % 2 == 0, F.lit("***-0001")).otherwise(F.col("c_custkey").cast("string")).alias("phone"), "c_name")
    return masks.misshapen(raw, {"email": "partial_email", "phone": "partial_phone", "c_name": "fixed_string"})


QUERIES = {n: _query(n) for n in STATEMENTS} | {"mask_shapes": mask_shapes, "mask_shapes_raw": mask_shapes_raw}
SQL = {n: (s if n == "raw_monitor" else (f"WITH {_RAW} SELECT * FROM ({s})" if s.startswith("WITH ") else f"WITH {_RAW} {s}")) for n, s in STATEMENTS.items()}
SQL["mask_shapes"] = "SELECT count(*) AS n_rows, 0::BIGINT AS email, 0::BIGINT AS phone, 0::BIGINT AS c_name FROM customer"
SQL["mask_shapes_raw"] = "SELECT count(*) AS n_rows, count(*) AS email, count(*) FILTER (c_custkey % 2 <> 0) AS phone, count(*) AS c_name FROM customer"
