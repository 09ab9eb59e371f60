"""Registered queries of the general problems (1, 4, 5, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.operators import hierarchy, history, nested, sessions, snapshot_diff
from quillgate.sources.tables import table
from quillgate.streaming import incremental


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "snapshots"), table(spark, d, "audit"))


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many data sets and columns each structural variant has."""
    sets = nested.datasets(table(spark, d, "snapshots"))
    both = sets.select(F.lit("dataset").alias("level"), "variant").unionByName(
        nested.columns(sets).select(F.lit("column").alias("level"), "variant")
    )
    return both.groupBy("level", "variant").agg(F.count("*").alias("n"))


def p1_datasets(spark: SparkSession, d: str) -> DataFrame:
    sets = nested.datasets(table(spark, d, "snapshots"))
    return sets.select(
        "rec_id", "urn", "variant", "platform", "name", "env", "lifecycle", "certification", "domain",
        F.size("owners").cast("bigint").alias("n_owners"), F.size("columns").cast("bigint").alias("n_columns"),
    )


def p1_columns(spark: SparkSession, d: str) -> DataFrame:
    cols = nested.columns(nested.datasets(table(spark, d, "snapshots")))
    return cols.select("rec_id", "dataset_urn", "name", "data_type", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("tags", "editable_tags", "terms")])


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Label nodes of a shape that no subtype takes."""
    return nested.rejects(table(spark, d, "snapshots"))


def p1_edges(spark: SparkSession, d: str) -> DataFrame:
    return nested.edges(table(spark, d, "snapshots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(table(spark, d, "dataset_facts"), table(spark, d, "column_facts"))


def p4_open_versions(spark: SparkSession, d: str) -> DataFrame:
    """Current values and how many versions stand behind them."""
    v = history.catalog_history(table(spark, d, "dataset_facts"), table(spark, d, "column_facts"))
    return v.groupBy("attribute", "urn").agg(F.max(F.when(F.col("to_us").isNull(), F.col("value"))).alias("fact_value"), F.count("*").alias("n_versions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found(table(spark, d, "lineage"), table(spark, d, "column_lineage"))


def _paths(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "lineage": hierarchy.paths(table(spark, d, "lineage"), "src_urn", "dst_urn"),
        "column_lineage": hierarchy.paths(table(spark, d, "column_lineage"), "upstream_urn", "field_urn"),
    }


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    a, b = (p.select(F.lit(g).alias("graph"), "node", "root", "depth", F.array_join("path", " > ").alias("path")) for g, p in _paths(spark, d).items())
    return a.unionByName(b)


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    a, b = (hierarchy.descendant_counts(p).withColumn("graph", F.lit(g)) for g, p in _paths(spark, d).items())
    return a.unionByName(b)


def p5_descendant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every node with its distance; nodes in and below loops, which have no path, too."""
    a, b = (
        hierarchy.descendant_pairs(hierarchy.ancestors(table(spark, d, g), parent, child)).withColumn("graph", F.lit(g))
        for g, parent, child in (("lineage", "src_urn", "dst_urn"), ("column_lineage", "upstream_urn", "field_urn"))
    )
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.changes(table(spark, d, "snapshots"))


def p6_intervals(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.validity(table(spark, d, "snapshots"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.found(table(spark, d, "audit"))


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Per principal: sessions, requests, longest session."""
    s = sessions.sessionize(sessions.audit_events(table(spark, d, "audit")))
    return s.groupBy(F.col("user").alias("principal")).agg(
        F.count("*").alias("n_sessions"), F.sum("n").cast("bigint").alias("n_requests"), F.max(F.col("end_us") - F.col("start_us")).alias("longest_us")
    )


def p7_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions, the log read as a stream."""
    s = incremental.run_sessions(spark, f"{d}/audit.parquet")
    return s.select(F.col("user").alias("principal"), "start_us", "end_us", F.col("n").alias("n_requests"))


_DATASETS = """
s AS (SELECT snap_id, source_url, compiled_at, payload::JSON p FROM snapshots WHERE json_valid(payload)),
t AS (SELECT snap_id, json_extract(p, '$.datasets') d FROM s),
ds AS (
  SELECT snap_id, k urn, 'keyed' layout, json_extract(d, '$."' || k || '"') n
  FROM (SELECT snap_id, d, unnest(json_keys(d)) k FROM t WHERE json_type(d) = 'OBJECT')
  UNION ALL
  SELECT snap_id, json_extract_string(n, '$.urn'), 'listed', n
  FROM (SELECT snap_id, unnest(json_extract(d, '$[*]')) n FROM t WHERE json_type(d) = 'ARRAY')),
cols AS (
  SELECT snap_id, urn, k AS name, 'keyed' lay, json_extract(c, '$."' || k || '"') n
  FROM (SELECT snap_id, urn, json_extract(n, '$.columns') c, unnest(json_keys(json_extract(n, '$.columns'))) k
        FROM ds WHERE json_type(json_extract(n, '$.columns')) = 'OBJECT')
  UNION ALL
  SELECT snap_id, urn, json_extract_string(n, '$.name'), 'listed', n
  FROM (SELECT snap_id, urn, unnest(json_extract(n, '$.columns[*]')) n FROM ds WHERE json_type(json_extract(n, '$.columns')) = 'ARRAY')),
lists AS (
  SELECT snap_id, urn, name, 'tags' kind, json_extract(n, '$.tags') v FROM cols
  UNION ALL SELECT snap_id, urn, name, 'editable_tags', json_extract(n, '$.editable.tags') FROM cols
  UNION ALL SELECT snap_id, urn, name, 'terms', json_extract(n, '$.terms') FROM cols
  UNION ALL SELECT snap_id, urn, NULL, 'tags', json_extract(n, '$.tags') FROM ds
  UNION ALL SELECT snap_id, urn, NULL, 'terms', json_extract(n, '$.terms') FROM ds
  UNION ALL SELECT snap_id, urn, NULL, 'owners', json_extract(n, '$.owners') FROM ds),
members AS (
  SELECT snap_id, urn, name, kind, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END) x FROM lists),
labs AS (
  SELECT snap_id, urn, name, kind,
    regexp_replace(CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(x->>'$.urn', x->>'$.name') ELSE x->>'$' END, '^(urn:li:tag:|urn:li:glossaryTerm:)', '') leaf
  FROM members WHERE x IS NOT NULL AND json_type(x) <> 'NULL')
"""

SQL = {
    "p1_found": f"""
WITH {_DATASETS}
SELECT DISTINCT 'payload' AS section, snap_id AS rec_id, urn AS parent, name AS child, leaf FROM labs
WHERE name IS NOT NULL AND kind <> 'owners' AND leaf <> ''
UNION ALL
SELECT DISTINCT 'verdict', line_no, v.subject, v.code, v.action FROM (SELECT line_no, unnest(verdicts) v FROM audit) WHERE v.code IS NOT NULL
UNION ALL
SELECT DISTINCT 'read', line_no, e.key, lower(c), '' FROM (
  SELECT line_no, e, unnest(e.value) c FROM (SELECT line_no, unnest(map_entries(column_reads)) e FROM audit)) WHERE c IS NOT NULL
""",
    "p1_datasets": f"""
WITH {_DATASETS}
SELECT snap_id AS rec_id, urn, layout || '(' || CASE WHEN json_type(json_extract(n, '$.columns')) = 'ARRAY' THEN 'list'
    WHEN json_type(json_extract(n, '$.columns')) = 'OBJECT' THEN 'map' ELSE 'none' END || ')' AS variant,
  n->>'$.platform' AS platform, n->>'$.name' AS name, n->>'$.env' AS env, n->>'$.lifecycle' AS lifecycle,
  n->>'$.certification' AS certification, n->>'$.domain' AS domain,
  (SELECT count(*) FROM labs l WHERE l.snap_id = ds.snap_id AND l.urn = ds.urn AND kind = 'owners' AND leaf <> '') AS n_owners,
  (SELECT count(*) FROM cols c WHERE c.snap_id = ds.snap_id AND c.urn = ds.urn AND c.name <> '') AS n_columns
FROM ds
""",
    "p1_columns": f"""
WITH {_DATASETS},
c AS (SELECT snap_id, urn, name, kind, count(*) m FROM labs WHERE name IS NOT NULL AND leaf <> '' GROUP BY ALL)
SELECT snap_id AS rec_id, urn AS dataset_urn, name, n->>'$.data_type' AS data_type,
  coalesce(max(CASE WHEN kind = 'tags' THEN m END), 0)::BIGINT AS n_tags,
  coalesce(max(CASE WHEN kind = 'editable_tags' THEN m END), 0)::BIGINT AS n_editable_tags,
  coalesce(max(CASE WHEN kind = 'terms' THEN m END), 0)::BIGINT AS n_terms
FROM cols LEFT JOIN c USING (snap_id, urn, name) WHERE name <> '' GROUP BY snap_id, urn, name, n
""",
    "p4_found": """
WITH f AS (
  SELECT urn, compiled_at, unnest([{'a': 'lifecycle', 'v': coalesce(upper(trim(lifecycle)), '')},
    {'a': 'certification', 'v': coalesce(upper(trim(certification)), '')}]) x
  FROM (SELECT * FROM dataset_facts WHERE compiled_at IS NOT NULL AND urn IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY urn, compiled_at ORDER BY fact_id DESC) = 1)
  UNION ALL
  SELECT urn, compiled_at, {'a': 'tags', 'v': coalesce(array_to_string(list_sort(list_distinct(list_filter(
    list_transform(tags, lambda t: regexp_replace(lower(t), '^urn:li:tag:', '')), lambda t: t IS NOT NULL AND t <> ''))), ','), '')}
  FROM (SELECT * FROM column_facts WHERE compiled_at IS NOT NULL AND urn IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY urn, compiled_at ORDER BY fact_id DESC) = 1)),
g AS (SELECT x.a attribute, urn, x.v fact_value, epoch_us(compiled_at) at_us,
        lag(x.v) OVER (PARTITION BY x.a, urn ORDER BY compiled_at) before FROM f),
h AS (SELECT * FROM g WHERE before IS NULL OR before <> fact_value)
SELECT attribute, urn, fact_value, at_us AS valid_from_us,
  coalesce(lead(at_us) OVER (PARTITION BY attribute, urn ORDER BY at_us), -1)::BIGINT AS valid_to_us FROM h
""",
    "p5_found": """
WITH RECURSIVE e AS (
  SELECT 'lineage' graph, src_urn up, dst_urn node FROM lineage
  UNION ALL SELECT 'column_lineage', upstream_urn, field_urn FROM column_lineage),
n AS (SELECT graph, node, min(up) up FROM (
  SELECT graph, node, up FROM e UNION ALL SELECT graph, up, NULL FROM e) WHERE node IS NOT NULL GROUP BY ALL),
r AS (
  SELECT graph, node, node root, 0::BIGINT AS depth FROM n WHERE up IS NULL
  UNION ALL SELECT n.graph, n.node, r.root, r.depth + 1 FROM r JOIN n ON n.graph = r.graph AND n.up = r.node),
l AS (SELECT graph, node, up FROM n ANTI JOIN r USING (graph, node)),
w AS (
  SELECT graph, node, up cur FROM l
  UNION SELECT w.graph, w.node, l.up FROM w JOIN l ON l.graph = w.graph AND l.node = w.cur)
SELECT graph, node AS node_urn, root AS root_urn, depth, 0::BIGINT AS on_cycle FROM r
UNION ALL
SELECT graph, node, '', -1, max(CASE WHEN cur = node THEN 1 ELSE 0 END)::BIGINT FROM w GROUP BY graph, node
""",
    "p5_paths": """
WITH RECURSIVE e AS (
  SELECT 'lineage' graph, src_urn up, dst_urn node FROM lineage
  UNION ALL SELECT 'column_lineage', upstream_urn, field_urn FROM column_lineage),
n AS (SELECT graph, node, min(up) up FROM (
  SELECT graph, node, up FROM e UNION ALL SELECT graph, up, NULL FROM e) WHERE node IS NOT NULL GROUP BY ALL),
r AS (
  SELECT graph, node, node root, 0::BIGINT AS depth, [node] AS path FROM n WHERE up IS NULL
  UNION ALL SELECT n.graph, n.node, r.root, r.depth + 1, list_append(r.path, n.node) FROM r JOIN n ON n.graph = r.graph AND n.up = r.node)
SELECT graph, node, root, depth, array_to_string(path, ' > ') AS path FROM r
""",
    "p5_descendants": """
WITH RECURSIVE e AS (
  SELECT 'lineage' graph, src_urn up, dst_urn node FROM lineage
  UNION ALL SELECT 'column_lineage', upstream_urn, field_urn FROM column_lineage),
n AS (SELECT graph, node, min(up) up FROM (
  SELECT graph, node, up FROM e UNION ALL SELECT graph, up, NULL FROM e) WHERE node IS NOT NULL GROUP BY ALL),
r AS (
  SELECT graph, node, node root, 0::BIGINT AS depth, [node] AS path FROM n WHERE up IS NULL
  UNION ALL SELECT n.graph, n.node, r.root, r.depth + 1, list_append(r.path, n.node) FROM r JOIN n ON n.graph = r.graph AND n.up = r.node),
d AS (SELECT graph, a node, depth - i + 1 distance FROM (SELECT graph, depth, unnest(path) a, generate_subscripts(path, 1) i FROM r) WHERE i <= depth)
SELECT r.graph, r.node, r.root, r.depth, count(d.node) AS n_descendants, count(CASE WHEN d.distance = 1 THEN 1 END) AS n_children
FROM r LEFT JOIN d ON d.graph = r.graph AND d.node = r.node GROUP BY r.graph, r.node, r.root, r.depth
""",
    "p5_descendant_pairs": """
WITH RECURSIVE e AS (
  SELECT 'lineage' graph, src_urn up, dst_urn node FROM lineage
  UNION ALL SELECT 'column_lineage', upstream_urn, field_urn FROM column_lineage),
n AS (SELECT graph, node, min(up) up FROM (
  SELECT graph, node, up FROM e UNION ALL SELECT graph, up, NULL FROM e) WHERE node IS NOT NULL GROUP BY ALL),
w AS (
  SELECT graph, up AS node, node AS descendant, 1::BIGINT AS distance, [up] AS seen FROM n WHERE up IS NOT NULL
  UNION ALL SELECT w.graph, n.up, w.descendant, w.distance + 1, list_append(w.seen, n.up) FROM w JOIN n ON n.graph = w.graph AND n.node = w.node
  WHERE n.up IS NOT NULL AND NOT list_contains(w.seen, n.up))
SELECT graph, node, descendant, distance FROM w
""",
    "p6_found": f"""
WITH {_DATASETS},
h AS (SELECT source_url, t0, min(snap_id) snap_id FROM (SELECT source_url, compiled_at::TIMESTAMPTZ t0, snap_id FROM s) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY t0) seq FROM h),
sets AS (SELECT snap_id, urn, name, CASE kind WHEN 'editable_tags' THEN 'tags' ELSE kind END kind,
  list_sort(list(DISTINCT leaf)) leaves FROM labs WHERE leaf <> '' GROUP BY ALL),
cc AS (SELECT c.snap_id, c.urn, list_sort(list(DISTINCT [c.name, coalesce(nullif(c.n->>'$.data_type', ''), '-'),
    coalesce(t.leaves::VARCHAR, ''), coalesce(m.leaves::VARCHAR, '')])) x
  FROM cols c LEFT JOIN sets t ON t.snap_id = c.snap_id AND t.urn = c.urn AND t.name = c.name AND t.kind = 'tags'
  LEFT JOIN sets m ON m.snap_id = c.snap_id AND m.urn = c.urn AND m.name = c.name AND m.kind = 'terms' GROUP BY ALL),
o AS (SELECT q.source_url, q.seq, q.snap_id, ds.urn, md5([
    coalesce(upper(trim(n->>'$.lifecycle')), ''), coalesce(upper(trim(n->>'$.certification')), ''), coalesce(n->>'$.domain', ''),
    coalesce(a.leaves::VARCHAR, ''), coalesce(b.leaves::VARCHAR, ''), coalesce(c.leaves::VARCHAR, ''), coalesce(cc.x::VARCHAR, '')]::VARCHAR) v
  FROM q JOIN ds USING (snap_id) LEFT JOIN cc ON cc.snap_id = ds.snap_id AND cc.urn = ds.urn
  LEFT JOIN sets a ON a.snap_id = ds.snap_id AND a.urn = ds.urn AND a.name IS NULL AND a.kind = 'owners'
  LEFT JOIN sets b ON b.snap_id = ds.snap_id AND b.urn = ds.urn AND b.name IS NULL AND b.kind = 'tags'
  LEFT JOIN sets c ON c.snap_id = ds.snap_id AND c.urn = ds.urn AND c.name IS NULL AND c.kind = 'terms')
SELECT z.snap_id, coalesce(x.urn, y.urn) AS dataset_urn,
  CASE WHEN y.urn IS NULL THEN 'added' WHEN x.urn IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o x FULL JOIN (SELECT source_url, seq + 1 seq, urn, v FROM o) y ON x.source_url = y.source_url AND x.seq = y.seq AND x.urn = y.urn
JOIN q z ON z.source_url = coalesce(x.source_url, y.source_url) AND z.seq = coalesce(x.seq, y.seq)
WHERE z.seq > 1 AND (x.v IS NULL OR y.v IS NULL OR x.v <> y.v)
""",
}
_SESSIONS = """
WITH a AS (SELECT request_id, line_no, lower(trim(principal)) principal, trim(ts) ts FROM audit WHERE principal IS NOT NULL AND request_id IS NOT NULL),
b AS (SELECT *, CASE WHEN regexp_matches(ts, '^[0-9]+$') THEN try_cast(ts AS BIGINT) * 1000
  WHEN regexp_matches(ts, '^[0-9]{4}-') THEN epoch_us(try_cast(CASE WHEN regexp_matches(ts, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ)) END at_us FROM a),
c AS (SELECT arg_min(principal, line_no) principal, arg_min(at_us, line_no) at_us FROM b WHERE at_us IS NOT NULL GROUP BY request_id),
d AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER w <= 1800000000 THEN 0 ELSE 1 END o FROM c WINDOW w AS (PARTITION BY principal ORDER BY at_us)),
e AS (SELECT *, sum(o) OVER (PARTITION BY principal ORDER BY at_us ROWS UNBOUNDED PRECEDING) k FROM d),
f AS (SELECT principal, min(at_us) AS start_us, max(at_us) AS end_us, count(*) AS n_requests FROM e GROUP BY principal, k)
"""
SQL["p7_found"] = _SESSIONS + "SELECT * FROM f"
SQL["p7_lengths"] = _SESSIONS + "SELECT principal, count(*) AS n_sessions, sum(n_requests)::BIGINT AS n_requests, max(end_us - start_us) AS longest_us FROM f GROUP BY principal"

def _state(path: str) -> str:
    v = f"json_extract(n, '{path}')"
    kinds = f"list_sort(list_distinct(list_filter(list_transform(json_extract({v}, '$[*]'), lambda x: json_type(x)), lambda t: t <> 'NULL')))::VARCHAR"
    inner = f"CASE {kinds} WHEN '[]' THEN 'empty' WHEN '[OBJECT]' THEN 'objects' WHEN '[OBJECT, VARCHAR]' THEN 'mixed' ELSE 'names' END"
    return f"CASE WHEN {v} IS NULL THEN 'absent' WHEN json_type({v}) = 'NULL' THEN 'null' WHEN json_type({v}) = 'OBJECT' THEN 'bare_object' WHEN json_type({v}) <> 'ARRAY' THEN 'bare' ELSE {inner} END"


SQL["p1_variants"] = f"""
WITH {_DATASETS}
SELECT 'column' AS level, lay || '(' || {_state('$.tags')} || ',' || {_state('$.terms')} || ',' || {_state('$.editable.tags')} || ')' AS variant, count(*) AS n FROM cols GROUP BY 2
UNION ALL
SELECT 'dataset', layout || '(' || CASE WHEN json_type(json_extract(n, '$.columns')) = 'ARRAY' THEN 'list' WHEN json_type(json_extract(n, '$.columns')) = 'OBJECT' THEN 'map' ELSE 'none' END || ')', count(*) FROM ds GROUP BY 2
"""
SQL["p1_rejects"] = f"""
WITH {_DATASETS}
SELECT snap_id AS rec_id, urn AS dataset_urn, name AS "column", '$.' || CASE kind WHEN 'editable_tags' THEN 'editable.tags' ELSE kind END AS path, 'ARRAY<ARRAY<STRING>>' AS schema
FROM lists WHERE name <> '' AND json_type(v) = 'ARRAY' AND len(json_extract(v, '$[*]')) > 0 AND len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) <> 'ARRAY')) = 0
"""
SQL["p4_open_versions"] = f"""
SELECT attribute, urn, max(CASE WHEN valid_to_us = -1 THEN fact_value END) AS fact_value, count(*) AS n_versions FROM ({SQL["p4_found"]}) GROUP BY 1, 2
"""
SQL["p6_intervals"] = SQL["p6_found"].split("SELECT z.snap_id")[0] + """,
v AS (SELECT source_url, urn, seq, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END f FROM o WINDOW w AS (PARTITION BY source_url, urn ORDER BY seq))
SELECT source_url AS source, urn AS key, sum(f)::BIGINT AS n_intervals, count(*) AS n_seen, min(seq) AS first_seq, max(seq) AS last_seq FROM v GROUP BY 1, 2
"""
SQL["p1_edges"] = """
WITH s AS (SELECT snap_id, payload::JSON p FROM snapshots WHERE json_valid(payload)),
e AS (SELECT snap_id, 'lineage' g, json_extract(p, '$.lineage') m FROM s UNION ALL SELECT snap_id, 'column_lineage', json_extract(p, '$.column_lineage') FROM s),
k AS (SELECT snap_id, g, k, json_extract(m, '$."' || k || '"') v FROM (SELECT snap_id, g, m, unnest(json_keys(m)) k FROM e WHERE json_type(m) = 'OBJECT')),
x AS (SELECT snap_id, g, k, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END) o, generate_subscripts(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END, 1) - 1 i FROM k)
SELECT snap_id AS rec_id, g AS graph, k AS urn, o->>'$' AS other, i AS ord FROM x WHERE json_type(o) = 'VARCHAR'
"""
SQL["p7_streamed"] = SQL["p7_found"]
# Groups of snapshots whose data sets are the same, one by one.
CONTENT_SQL = SQL["p6_found"].split("SELECT z.snap_id")[0].replace("FROM q JOIN ds USING (snap_id)", "FROM (SELECT '' source_url, 0 seq, snap_id FROM s) q JOIN ds USING (snap_id)") + """,
r AS (SELECT snap_id, list_sort(list([urn, v])) c FROM (SELECT snap_id, urn, v FROM o) GROUP BY 1)
SELECT min(r.snap_id) AS first_snap, count(*) AS n_snapshots, count(DISTINCT hash) AS n_hashes FROM r JOIN snapshots USING (snap_id) GROUP BY c
"""

QUERIES = {f.__name__: f for f in (
    p1_found, p1_variants, p1_datasets, p1_columns, p1_rejects, p1_edges, p4_found, p4_open_versions, p5_found, p5_paths, p5_descendants, p5_descendant_pairs, p6_found, p6_intervals, p7_found, p7_lengths, p7_streamed,
)}
