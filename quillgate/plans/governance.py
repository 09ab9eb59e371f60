"""Registered queries of the catalog, policy and usage operators, with their SQL.

The rules and scopes below are an example configuration over the tables' own
tags, terms and domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.operators import coverage, decide, nested, policy, snapshot_diff, usage
from quillgate.operators.policy import Rule, Scope
from quillgate.plans import problems
from quillgate.session import scratch
from quillgate.sources import audit_log, snapshot_store
from quillgate.sources.tables import table
from quillgate.streaming import incremental

RULES = [
    Rule("pii-default", "mask", "auto", tag="pii"),
    Rule("contact-mask", "mask", "partial", tag="contact"),
    Rule("secret-deny", "deny", term="classification.secret"),
    Rule("billing-balance", "allow", term="glossary.balance", domain="Billing"),
    Rule("balance-mask", "mask", "hash", term="glossary.balance"),
    Rule("retired-redirect", "substitute_certified", lifecycle="DEPRECATED"),
    Rule("gdpr-deny", "deny", tag="gdpr"),
]
SCOPES = [
    Scope("parks-agent", frozenset({"Parks", "Grid"})),
    Scope("snow-agent", None, frozenset({"snowflake"})),
    Scope("lending-agent", frozenset({"Lending"}), frozenset({"postgres", "snowflake"})),
]


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return policy.catalog_datasets(table(spark, d, "dataset_facts"))


def _cols(spark: SparkSession, d: str) -> DataFrame:
    return policy.catalog_columns(table(spark, d, "column_facts"), _sets(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return policy.outcomes(_cols(spark, d), table(spark, d, "column_lineage"), RULES)


def column_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("urn", "action", "rule_id", "strategy", "source")


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return coverage.summary(_outcomes(spark, d))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return coverage.gaps(_outcomes(spark, d))


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.proposals(coverage.gaps(_outcomes(spark, d)))


def dead_rules(spark: SparkSession, d: str) -> DataFrame:
    return coverage.dead_rules(_cols(spark, d), _sets(spark, d), RULES)


def unowned(spark: SparkSession, d: str) -> DataFrame:
    return coverage.unowned(_sets(spark, d))


def unreachable(spark: SparkSession, d: str) -> DataFrame:
    return coverage.unreachable(_sets(spark, d), SCOPES)


def orphan_deprecated(spark: SparkSession, d: str) -> DataFrame:
    return coverage.orphan_deprecated(_sets(spark, d), table(spark, d, "lineage"))


def visible_tables(spark: SparkSession, d: str) -> DataFrame:
    return policy.visible(_sets(spark, d), SCOPES)


def certified_substitutes(spark: SparkSession, d: str) -> DataFrame:
    return policy.substitutes(_sets(spark, d), table(spark, d, "lineage")).withColumn("ord", F.col("ord").cast("bigint"))


def substitute_pick(spark: SparkSession, d: str) -> DataFrame:
    reads = usage.reads(table(spark, d, "audit")).select("dataset_urn", F.explode("columns").alias("column"))
    sets = _sets(spark, d)
    return policy.covering(reads, _cols(spark, d), policy.substitutes(sets, table(spark, d, "lineage")))


def name_index(spark: SparkSession, d: str) -> DataFrame:
    return policy.name_index(_sets(spark, d))


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(table(spark, d, "audit"))


def usage_streamed(spark: SparkSession, d: str) -> DataFrame:
    return incremental.run_daily_usage(spark, f"{d}/audit.parquet")


def usage_by_principal(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_principal(table(spark, d, "audit"))


def usage_by_column(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_column(table(spark, d, "audit"))


def top_sql(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_sql(table(spark, d, "audit"))


def denied_attempts(spark: SparkSession, d: str) -> DataFrame:
    return usage.dataset_ledger(table(spark, d, "audit"))


def ledger_recent(spark: SparkSession, d: str) -> DataFrame:
    return usage.recent(table(spark, d, "audit"))


def explain_last(spark: SparkSession, d: str) -> DataFrame:
    return usage.last_lines(table(spark, d, "audit"))


def usage_read_back(spark: SparkSession, d: str) -> DataFrame:
    return usage.read_back(table(spark, d, "day_usage"))


def audit_replay(spark: SparkSession, d: str) -> DataFrame:
    return usage.replay(table(spark, d, "audit"), _outcomes(spark, d))


def decision_grid(spark: SparkSession, d: str) -> DataFrame:
    return decide.grid(_outcomes(spark, d))


def audit_decided(spark: SparkSession, d: str) -> DataFrame:
    reads = usage.reads(table(spark, d, "audit")).select("dataset_urn", F.explode("columns").alias("column"))
    return decide.decided_reads(reads, _outcomes(spark, d))


def scope_denials(spark: SparkSession, d: str) -> DataFrame:
    """Logged requests of each agent for data sets outside its scope; the agents are read into the log's principals by hash."""
    rq = usage.requests(table(spark, d, "audit")).select("principal", F.explode("dataset_urns").alias("dataset_urn"))
    agent = F.element_at(F.array(*[F.lit(s.principal) for s in SCOPES]), (F.length("principal") % len(SCOPES) + 1).cast("int"))
    return policy.out_of_scope(rq.where("principal IS NOT NULL").withColumn("principal", agent), _sets(spark, d), SCOPES)


def redirected_reads(spark: SparkSession, d: str) -> DataFrame:
    """Logged reads of deprecated data sets with the certified one they would go to."""
    sets, cols = _sets(spark, d), _cols(spark, d)
    have = cols.groupBy(F.col("dataset_urn").alias("substitute")).agg(F.collect_set(F.lower("column")).alias("columns"))
    picks = policy.substitutes(sets, table(spark, d, "lineage")).join(have, "substitute")
    reads = usage.reads(table(spark, d, "audit")).select(F.col("line_no").alias("request"), "dataset_urn", F.explode("columns").alias("column")).where("column IS NOT NULL")
    return policy.redirected(reads, picks).where("code IS NOT NULL").select("request", "dataset_urn", "n_columns", "effective_urn", F.col("code").cast("bigint").alias("code"))


def coverage_total(spark: SparkSession, d: str) -> DataFrame:
    """One row over the whole catalog, with the grade."""
    o, sets = _outcomes(spark, d), _sets(spark, d)
    counts = [coverage.gaps(o), coverage.dead_rules(_cols(spark, d), sets, RULES), coverage.orphan_deprecated(sets, table(spark, d, "lineage")), coverage.unowned(sets)]
    n = [c.agg(F.count("*").alias(k)) for c, k in zip(counts, ("n_gaps", "n_dead", "n_orphans", "n_unowned"))]
    governed = F.count_if(F.col("action").isin("mask", "deny"))
    total = o.agg(F.count("*").alias("n_columns"), governed.alias("n_governed"), F.round(100.0 * governed / F.count("*"), 6).alias("governed_pct"))
    for x in n:  # one row each
        total = total.join(x, F.lit(True))
    grade = F.when(F.col("n_gaps") > 0, "at-risk").when((F.col("n_dead") > 0) | (F.col("n_orphans") > 0) | (F.col("n_unowned") > 0), "gaps").otherwise("clear")
    return total.withColumn("grade", grade)


def usage_ledger_merged(spark: SparkSession, d: str) -> DataFrame:
    """The ledger merged from two deliveries of the log; a request's first line holds over both."""
    audit = table(spark, d, "audit")
    first = usage.requests(audit).select("line_no")
    lines = audit.join(first, "line_no", "left_semi")
    low, high = audit.agg(F.min("line_no"), F.max("line_no")).first()
    half = ((low or 0) + (high or 0)) // 2
    return usage.merge_ledger(usage.dataset_ledger(lines.where(F.col("line_no") <= half)), usage.dataset_ledger(lines.where(F.col("line_no") > half)))


def describe_table(spark: SparkSession, d: str) -> DataFrame:
    return policy.described(_outcomes(spark, d), _sets(spark, d), SCOPES)


def certified_by_label(spark: SparkSession, d: str) -> DataFrame:
    return policy.certified_by_label(_sets(spark, d))


def audit_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The audit written as JSON lines and read back: lines, verdicts, subjects and reads by status."""
    at = scratch(spark, "audit-log")
    audit_log.append(table(spark, d, "audit"), at)
    log = audit_log.normalized(audit_log.read(spark, at))
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("bigint")
    return log.groupBy("status").agg(F.count("*").alias("n_lines"), F.count_if("denied").alias("n_denied"), n("verdicts").alias("n_verdicts"), n("subjects").alias("n_subjects"), n("column_reads").alias("n_reads"), F.max("line_no").alias("last_line"))


def stored_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog saved twice in a snapshot store and the newest read back: columns of each data set."""
    store = snapshot_store.SnapshotStore(spark, scratch(spark, "catalogs"), keep=1)
    for _ in range(2):
        store.save({"datasets": _sets(spark, d), "columns": _cols(spark, d)})
    newest = store.newest()
    n = newest["columns"].groupBy(F.col("dataset_urn").alias("urn")).agg(F.count("*").alias("n_columns"))
    return newest["datasets"].join(n, "urn", "left").select("urn", "platform", "lifecycle", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


def snapshot_content(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots whose content is equal though their recorded hashes may differ: size of each group."""
    snaps = table(spark, d, "snapshots")
    rows = nested.datasets(snaps).select("rec_id", "urn", snapshot_diff.dataset_hash().alias("row_hash"))
    named = nested.content_hashes(rows).join(snaps.select(F.col("snap_id").alias("rec_id"), "hash"), "rec_id")
    return named.groupBy("content").agg(F.min("rec_id").alias("first_snap"), F.count("*").alias("n_snapshots"), F.countDistinct("hash").alias("n_hashes")).drop("content")


_CATALOG = """
ds AS (
  SELECT urn, platform, name, env, coalesce(upper(trim(lifecycle)), '') lifecycle, coalesce(upper(trim(certification)), '') certification,
    nullif(domain, '') AS domain, list_filter(coalesce(owners, []), lambda o: o IS NOT NULL AND o <> '') owners,
    list_transform(list_filter(coalesce(tags, []), lambda o: o <> ''), lambda o: lower(regexp_replace(o, '^(urn:li:tag:|urn:li:glossaryTerm:)', ''))) tags,
    list_transform(list_filter(coalesce(terms, []), lambda o: o <> ''), lambda o: lower(regexp_replace(o, '^(urn:li:tag:|urn:li:glossaryTerm:)', ''))) terms
  FROM (SELECT * FROM dataset_facts WHERE urn IS NOT NULL AND compiled_at IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY urn ORDER BY compiled_at DESC, fact_id DESC) = 1)),
co AS (
  SELECT c.urn, c.dataset_urn, c.name AS col, data_type, d.name AS dataset, d.platform, d.domain,
    list_transform(list_filter(coalesce(c.tags, []), lambda o: o <> ''), lambda o: lower(regexp_replace(o, '^(urn:li:tag:|urn:li:glossaryTerm:)', ''))) tags,
    list_transform(list_filter(coalesce(c.terms, []), lambda o: o <> ''), lambda o: lower(regexp_replace(o, '^(urn:li:tag:|urn:li:glossaryTerm:)', ''))) terms
  FROM (SELECT * FROM column_facts WHERE urn IS NOT NULL AND compiled_at IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY urn ORDER BY compiled_at DESC, fact_id DESC) = 1) c LEFT JOIN ds d ON d.urn = c.dataset_urn),
own AS (
  SELECT *, CASE WHEN list_contains(terms, 'classification.secret') OR list_contains(tags, 'gdpr') THEN 'deny'
      WHEN list_contains(terms, 'glossary.balance') OR list_contains(tags, 'pii') OR list_contains(tags, 'contact') THEN 'mask' END act,
    CASE WHEN list_contains(tags, 'gdpr') THEN 'gdpr-deny' WHEN list_contains(terms, 'classification.secret') THEN 'secret-deny'
      WHEN list_contains(terms, 'glossary.balance') THEN 'balance-mask' WHEN list_contains(tags, 'contact') THEN 'contact-mask'
      WHEN list_contains(tags, 'pii') THEN 'pii-default' END rid
  FROM co),
walk AS (
  SELECT o.urn AS start, u.urn AS at, u.act, u.rid, u.dataset || '.' || u.col AS src, 1 AS step
  FROM own o JOIN (SELECT DISTINCT field_urn, upstream_urn FROM column_lineage) l ON l.field_urn = o.urn JOIN own u ON u.urn = l.upstream_urn WHERE o.act IS NULL
  UNION ALL
  SELECT w.start, u.urn, u.act, u.rid, u.dataset || '.' || u.col, w.step + 1
  FROM walk w JOIN (SELECT DISTINCT field_urn, upstream_urn FROM column_lineage) l ON l.field_urn = w.at JOIN own u ON u.urn = l.upstream_urn
  WHERE w.act IS NULL AND w.step < 200),
outc AS (
  SELECT o.urn, o.dataset_urn, o.dataset, o.col, o.data_type, o.domain, o.tags, o.terms, coalesce(o.act, w.act, 'allow') AS action, coalesce(o.rid, w.rid) AS rule_id, w.src AS source
  FROM own o LEFT JOIN (SELECT * FROM walk WHERE act IS NOT NULL QUALIFY row_number() OVER (PARTITION BY start ORDER BY act <> 'deny', src) = 1) w ON w.start = o.urn)
"""
_C = "WITH RECURSIVE " + _CATALOG.lstrip()
_REASON = """CASE {words} {phrases} END"""


def _reason(col: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    names = list(coverage.SENSITIVE_WORDS)
    first = f"list_filter({words}, lambda w: list_contains({names!r}, w))[1]"
    lookup = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in coverage.SENSITIVE_WORDS.items())
    phrases = " ".join(f"WHEN contains(' ' || array_to_string({words}, ' ') || ' ', ' {k} ') THEN '{v}'" for k, v in coverage.SENSITIVE_PHRASES.items())
    return f"coalesce(CASE {first} {lookup} END, CASE {phrases} END)"


_GAPS = _C + f", gap AS (SELECT dataset_urn, dataset, col, data_type, {_reason('col')} reason FROM outc WHERE action NOT IN ('mask', 'deny')) "
_REQUESTS = """
WITH rq AS (
  SELECT line_no, request_id, lower(trim(principal)) principal, coalesce(executed_sql, original_sql) stmt, coalesce(denied, false) denied, snapshot_hash, dataset_urns, column_reads,
    CASE WHEN regexp_matches(trim(ts), '^[0-9]+$') THEN try_cast(trim(ts) AS BIGINT) * 1000
      WHEN regexp_matches(trim(ts), '^[0-9]{4}-') THEN epoch_us(try_cast(CASE WHEN regexp_matches(trim(ts), '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN trim(ts) ELSE trim(ts) || 'Z' END AS TIMESTAMPTZ)) END at_us
  FROM audit WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY line_no) = 1),
rl AS (
  SELECT e.key dataset_urn, (at_us // 86400000000 * 86400000)::BIGINT bucket_ms, line_no, principal, denied, stmt, list_distinct(list_transform(e.value, lambda c: lower(c))) cols
  FROM (SELECT *, unnest(map_entries(column_reads)) e FROM rq)),
rd AS (SELECT * FROM rl WHERE bucket_ms IS NOT NULL AND NOT denied)
"""
_URNS = _REQUESTS + ", u AS (SELECT DISTINCT line_no, principal, denied, snapshot_hash, unnest(dataset_urns) dataset_urn FROM rq) "

SQL = {
    "column_outcomes": _C + """SELECT urn, action, rule_id, CASE rule_id WHEN 'pii-default' THEN 'auto' WHEN 'contact-mask' THEN 'partial' WHEN 'balance-mask' THEN 'hash' END AS strategy, source FROM outc""",
    "coverage_summary": _C + """SELECT coalesce(domain, '') AS domain, count(DISTINCT dataset_urn) AS n_datasets, count(*) AS n_columns,
      count(*) FILTER (len(tags) > 0 OR len(terms) > 0) AS n_classified, count(*) FILTER (action = 'mask') AS n_masked, count(*) FILTER (action = 'deny') AS n_denied,
      round(100.0 * count(*) FILTER (action IN ('mask', 'deny')) / count(*), 6) AS governed_pct FROM outc GROUP BY 1""",
    "coverage_gaps": _GAPS + """SELECT dataset_urn, dataset, col AS "column", data_type, reason FROM gap WHERE reason IS NOT NULL""",
    "proposals": _GAPS + """SELECT dataset_urn, string_agg(DISTINCT col || ': looks like ' || reason, '; ' ORDER BY col || ': looks like ' || reason) AS proposal FROM gap WHERE reason IS NOT NULL GROUP BY 1""",
    "dead_rules": _C + """SELECT id FROM (
      SELECT 'pii-default' id, (SELECT count(*) FROM co WHERE list_contains(tags, 'pii')) n UNION ALL SELECT 'contact-mask', (SELECT count(*) FROM co WHERE list_contains(tags, 'contact'))
      UNION ALL SELECT 'secret-deny', (SELECT count(*) FROM co WHERE list_contains(terms, 'classification.secret')) UNION ALL SELECT 'gdpr-deny', (SELECT count(*) FROM co WHERE list_contains(tags, 'gdpr'))
      UNION ALL SELECT 'billing-balance', (SELECT count(*) FROM co WHERE list_contains(terms, 'glossary.balance') AND domain = 'Billing')
      UNION ALL SELECT 'balance-mask', (SELECT count(*) FROM co WHERE list_contains(terms, 'glossary.balance'))
      UNION ALL SELECT 'retired-redirect', (SELECT count(*) FROM ds WHERE lifecycle = 'DEPRECATED')) WHERE n = 0""",
    "unowned": _C + "SELECT urn, name FROM ds WHERE len(owners) = 0",
    "unreachable": _C + """SELECT urn, name FROM ds WHERE NOT (coalesce(domain IN ('Parks', 'Grid'), false) OR coalesce(platform = 'snowflake', false)
      OR coalesce(domain = 'Lending' AND platform IN ('postgres', 'snowflake'), false))""",
    "orphan_deprecated": _C + """SELECT urn, name FROM ds WHERE lifecycle = 'DEPRECATED' AND NOT EXISTS (
      SELECT 1 FROM lineage l JOIN ds g ON g.urn = l.dst_urn WHERE l.src_urn = ds.urn AND g.certification = 'CERTIFIED' AND g.lifecycle <> 'DEPRECATED')""",
    "visible_tables": _C + """SELECT 'parks-agent' AS principal, urn, name FROM ds WHERE domain IN ('Parks', 'Grid') UNION ALL SELECT 'snow-agent', urn, name FROM ds WHERE platform = 'snowflake'
      UNION ALL SELECT 'lending-agent', urn, name FROM ds WHERE domain = 'Lending' AND platform IN ('postgres', 'snowflake')""",
    "certified_substitutes": _C + """SELECT l.src_urn AS urn, l.dst_urn AS substitute, min(l.ord)::BIGINT AS ord FROM lineage l JOIN ds o ON o.urn = l.src_urn AND o.lifecycle = 'DEPRECATED'
      JOIN ds g ON g.urn = l.dst_urn AND g.certification = 'CERTIFIED' AND g.lifecycle <> 'DEPRECATED' GROUP BY 1, 2""",
    "name_index": _C + """SELECT key, count(*) AS n_datasets, CASE WHEN count(*) = 1 THEN min(urn) END AS urn FROM (
      SELECT DISTINCT urn, array_to_string(p[i:], '.') key FROM (SELECT urn, p, unnest(range(1, len(p) + 1)) i FROM (SELECT urn, string_split(lower(name), '.') p FROM ds WHERE name IS NOT NULL))) GROUP BY key""",
    "usage_daily": _REQUESTS + "SELECT dataset_urn, bucket_ms, count(*) AS queries, count(DISTINCT principal) AS unique_users FROM rd GROUP BY 1, 2",
    "usage_by_principal": _REQUESTS + "SELECT dataset_urn, bucket_ms, principal, count(*) AS queries FROM rd WHERE principal IS NOT NULL GROUP BY 1, 2, 3",
    "usage_by_column": _REQUESTS + """SELECT dataset_urn, bucket_ms, col AS "column", count(*) AS queries FROM (SELECT dataset_urn, bucket_ms, unnest(cols) col FROM rd) WHERE col IS NOT NULL GROUP BY 1, 2, 3""",
    "top_sql": _REQUESTS + """SELECT dataset_urn, bucket_ms, row_number() OVER (PARTITION BY dataset_urn, bucket_ms ORDER BY n DESC, f)::BIGINT AS place, substr(stmt, 1, 2000) AS statement, n
      FROM (SELECT dataset_urn, bucket_ms, stmt, count(*) n, min(line_no) f FROM rd WHERE stmt IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY dataset_urn, bucket_ms ORDER BY n DESC, f) <= 5""",
    "denied_attempts": _URNS + """SELECT dataset_urn, count(*) AS n_requests, count(*) FILTER (denied) AS denied_attempts, max(line_no) AS last_line, arg_max(coalesce(principal, chr(0)), line_no) AS lp,
      coalesce(arg_max(coalesce(snapshot_hash, 'unknown'), line_no), 'unknown') AS last_snapshot FROM u WHERE dataset_urn IS NOT NULL GROUP BY 1""",
    "ledger_recent": _URNS + "SELECT dataset_urn, row_number() OVER (PARTITION BY dataset_urn ORDER BY line_no DESC)::BIGINT AS place, line_no FROM u WHERE dataset_urn IS NOT NULL QUALIFY place <= 50",
    "explain_last": """SELECT request_id, line_no, status, row_count, coalesce(len(verdicts), 0)::BIGINT AS n_verdicts FROM audit WHERE request_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY line_no DESC) = 1""",
    "usage_read_back": """SELECT dataset_urn, sum(queries)::BIGINT AS queries, max(coalesce(len(list_distinct(list_transform(map_keys(by_principal), lambda p: lower(trim(p))))), 0))::BIGINT AS most_users, count(*) AS n_days
      FROM day_usage GROUP BY 1 HAVING sum(queries) > 0""",
    "audit_replay": _C + ", " + _REQUESTS.lstrip().removeprefix("WITH ") + """, x AS (SELECT line_no, e.key dataset_urn, unnest(list_distinct(list_transform(e.value, lambda c: lower(c)))) col FROM (SELECT line_no, unnest(map_entries(column_reads)) e FROM rq)),
      y AS (SELECT x.*, coalesce(o.action, 'unknown') AS action FROM x LEFT JOIN outc o ON o.dataset_urn = x.dataset_urn AND lower(o.col) = x.col)
      SELECT dataset_urn, action, count(*) AS n_reads, count(DISTINCT line_no) AS n_requests FROM y GROUP BY 1, 2""",
}
SQL["usage_streamed"] = SQL["usage_daily"]
_EFFECT = """CASE WHEN action = 'deny' AND ctx = 'projection' AND NOT agg THEN (CASE WHEN source IS NULL THEN 120 ELSE 122 END, 'deny_column')
  WHEN action = 'deny' AND agg THEN (121, 'deny_statement') WHEN action = 'deny' THEN (120, 'deny_statement') WHEN ctx = 'predicate' THEN (130, 'deny_statement')
  WHEN ctx = 'order_by' THEN (111, 'note') WHEN source IS NOT NULL THEN (113, 'mask') ELSE (110, 'mask') END"""
SQL["decision_grid"] = _C + f""", gr AS (SELECT *, {_EFFECT} e FROM outc, (SELECT unnest(['projection', 'predicate', 'group_by', 'order_by']) ctx), (SELECT unnest([true, false]) agg) WHERE action IN ('mask', 'deny'))
  SELECT urn, ctx AS context, agg AS in_aggregate, e[1]::INT AS code, e[2] AS effect FROM gr"""
SQL["audit_decided"] = _C + ", " + _REQUESTS.lstrip().removeprefix("WITH ") + """, x AS (SELECT dataset_urn, unnest(cols) col FROM rl),
  y AS (SELECT x.dataset_urn, CASE WHEN o.action IS NULL THEN 409 WHEN action = 'allow' THEN 0 WHEN action = 'deny' THEN (CASE WHEN source IS NULL THEN 120 ELSE 122 END) ELSE (CASE WHEN source IS NULL THEN 110 ELSE 113 END) END code,
    CASE WHEN o.action IS NULL THEN 'error' WHEN action = 'allow' THEN 'allow' WHEN action = 'deny' THEN 'deny_column' ELSE 'mask' END effect
    FROM x LEFT JOIN outc o ON o.dataset_urn = x.dataset_urn AND lower(o.col) = x.col)
  SELECT dataset_urn, code::INT AS code, effect, count(*) AS n_reads FROM y GROUP BY ALL"""
SQL["describe_table"] = _C + ", vis AS (" + SQL["visible_tables"].removeprefix(_C) + """)
  SELECT principal, dataset_urn, col AS "column", data_type, CASE action WHEN 'mask' THEN 'mask:' || CASE rule_id WHEN 'pii-default' THEN 'auto' WHEN 'contact-mask' THEN 'partial' ELSE 'hash' END ELSE action END AS policy
  FROM outc JOIN vis ON vis.urn = outc.dataset_urn"""
SQL["certified_by_label"] = _C + "SELECT urn, name FROM ds WHERE len(list_filter(list_concat(tags, terms), lambda x: contains(x, 'certified'))) > 0"
SQL["denied_attempts"] = "SELECT dataset_urn, n_requests, denied_attempts, last_line, nullif(lp, chr(0)) AS last_principal, last_snapshot FROM (" + SQL["denied_attempts"] + ")"
SQL["substitute_pick"] = _C + ", " + _REQUESTS.lstrip().removeprefix("WITH ") + """,
  w AS (SELECT DISTINCT dataset_urn urn, unnest(cols) c FROM rl), s AS (SELECT l.src_urn urn, l.dst_urn sub, min(l.ord) ord FROM lineage l JOIN ds o ON o.urn = l.src_urn AND o.lifecycle = 'DEPRECATED'
    JOIN ds g ON g.urn = l.dst_urn AND g.certification = 'CERTIFIED' AND g.lifecycle <> 'DEPRECATED' GROUP BY 1, 2),
  h AS (SELECT DISTINCT dataset_urn, lower(col) c FROM co),
  z AS (SELECT w.urn, s.sub, s.ord, count(*) FILTER (h.c IS NULL) n FROM w JOIN s ON s.urn = w.urn LEFT JOIN h ON h.dataset_urn = s.sub AND h.c = w.c GROUP BY ALL)
  SELECT urn, sub AS substitute, n AS n_missing FROM z QUALIFY row_number() OVER (PARTITION BY urn ORDER BY n, ord, sub) = 1"""

SQL["usage_ledger_merged"] = SQL["denied_attempts"]
SQL["scope_denials"] = _C + ", " + _REQUESTS.lstrip().removeprefix("WITH ") + """, u AS (SELECT CASE length(principal) % 3 WHEN 0 THEN 'parks-agent' WHEN 1 THEN 'snow-agent' ELSE 'lending-agent' END principal, urn
    FROM (SELECT DISTINCT line_no, principal, unnest(dataset_urns) urn FROM rq WHERE principal IS NOT NULL) WHERE urn IS NOT NULL)
  SELECT principal, u.urn, 301 AS code, count(*) AS n_requests FROM u LEFT JOIN ds USING (urn)
  WHERE NOT coalesce(CASE principal WHEN 'parks-agent' THEN domain IN ('Parks', 'Grid') WHEN 'snow-agent' THEN platform = 'snowflake' ELSE domain = 'Lending' AND platform IN ('postgres', 'snowflake') END, false) GROUP BY 1, 2"""
SQL["redirected_reads"] = _C + ", " + _REQUESTS.lstrip().removeprefix("WITH ") + """, a AS (SELECT line_no, dataset_urn, list_filter(cols, lambda c: c IS NOT NULL) cs FROM rl),
  h AS (SELECT dataset_urn, list(DISTINCT lower(col)) have FROM co GROUP BY 1),
  p AS (SELECT l.src_urn old, l.dst_urn sub, min(l.ord) ord, any_value(have) have FROM lineage l JOIN ds o ON o.urn = l.src_urn AND o.lifecycle = 'DEPRECATED'
    JOIN ds g ON g.urn = l.dst_urn AND g.certification = 'CERTIFIED' AND g.lifecycle <> 'DEPRECATED' JOIN h ON h.dataset_urn = l.dst_urn GROUP BY 1, 2),
  z AS (SELECT line_no, dataset_urn, any_value(len(cs)) n, min(CASE WHEN len(list_filter(cs, lambda c: NOT list_contains(have, c))) = 0 THEN {'o': ord, 's': sub} END) b FROM a JOIN p ON p.old = a.dataset_urn WHERE len(cs) > 0 GROUP BY 1, 2)
  SELECT line_no AS request, dataset_urn, n AS n_columns, coalesce(b.s, dataset_urn) AS effective_urn, CASE WHEN b IS NULL THEN 202 ELSE 201 END::BIGINT AS code FROM z"""
SQL["coverage_total"] = _GAPS + """, dead AS (""" + SQL["dead_rules"].removeprefix(_C) + """), orph AS (""" + SQL["orphan_deprecated"].removeprefix(_C) + """),
  t AS (SELECT count(*) n_columns, count(*) FILTER (action IN ('mask', 'deny')) n_governed FROM outc), m AS (SELECT *, round(100.0 * n_governed / n_columns, 6) AS governed_pct,
    (SELECT count(*) FROM gap WHERE reason IS NOT NULL) n_gaps, (SELECT count(*) FROM dead) n_dead, (SELECT count(*) FROM orph) n_orphans, (SELECT count(*) FROM ds WHERE len(owners) = 0) n_unowned FROM t)
  SELECT *, CASE WHEN n_gaps > 0 THEN 'at-risk' WHEN n_dead > 0 OR n_orphans > 0 OR n_unowned > 0 THEN 'gaps' ELSE 'clear' END AS grade FROM m"""
SQL["snapshot_content"] = problems.CONTENT_SQL
SQL["audit_log_round_trip"] = """SELECT status, count(*) AS n_lines, count(*) FILTER (status IN ('denied', 'error')) AS n_denied, sum(coalesce(len(verdicts), 0))::BIGINT AS n_verdicts,
  sum(coalesce(len(list_distinct(list_filter(list_transform(verdicts, lambda v: v.subject), lambda x: x IS NOT NULL))), 0))::BIGINT AS n_subjects,
  sum(coalesce(cardinality(column_reads), 0))::BIGINT AS n_reads, max(line_no) AS last_line FROM audit GROUP BY status"""
SQL["stored_catalog"] = _C + "SELECT ds.urn, ds.platform, lifecycle, count(co.urn) AS n_columns FROM ds LEFT JOIN co ON co.dataset_urn = ds.urn GROUP BY 1, 2, 3"

QUERIES = {f.__name__: f for f in (
    column_outcomes, coverage_summary, coverage_gaps, proposals, dead_rules, unowned, unreachable, orphan_deprecated, visible_tables, certified_substitutes,
    substitute_pick, name_index, usage_daily, usage_streamed, usage_by_principal, usage_by_column, top_sql, denied_attempts, ledger_recent, explain_last, usage_read_back, audit_replay,
    decision_grid, audit_decided, scope_denials, redirected_reads, coverage_total, usage_ledger_merged, describe_table, certified_by_label, audit_log_round_trip, stored_catalog, snapshot_content,
)}
