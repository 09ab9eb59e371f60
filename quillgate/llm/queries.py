"""Registered queries of the text and record problems (2, 3, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.llm import formats, leaks, mixing, pairs, spans
from quillgate.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return formats.copies(formats.keyed(table(spark, d, "audit"), table(spark, d, "day_usage")))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per canonical statement of the audit, with its number of copies."""
    rows = formats.keyed(table(spark, d, "audit"), table(spark, d, "day_usage"))
    return formats.groups(rows).select("origin", "rec_id", "first_no", F.col("n").alias("n_copies"))


def p2_collisions(spark: SparkSession, d: str) -> DataFrame:
    return formats.collisions(formats.keyed(table(spark, d, "audit"), table(spark, d, "day_usage")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "audit"))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return pairs.scored(table(spark, d, "audit"), least=5)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.search(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: pages that hold it, those with its answer too, and the longest run of its words on any."""
    hits = _leaks(spark, d).where(F.col("n_words") >= leaks.LEAST_WORDS)
    return hits.groupBy("item_id").agg(F.count("*").alias("n_pages"), F.count_if("answered").alias("n_answered"), F.max("n_words").alias("longest_run"))


def p8_reworded(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold half of an item's words in order and its answer, without a run of twelve words."""
    return leaks.reworded(_leaks(spark, d)).select("doc_id", "item_id", "n_words", "n_held")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix(mixing.counted(table(spark, d, "documents"), targets), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    pages = mixing.counted(table(spark, d, "documents"), targets)
    return mixing.shares(pages, targets, mixing.mix(pages, targets))


def p9_capped(spark: SparkSession, d: str) -> DataFrame:
    """Shares when as many tokens are asked for as all the target sources hold: what the caps leave short."""
    targets = table(spark, d, "mix_targets")
    pages = mixing.counted(table(spark, d, "documents"), targets)
    total = pages.agg(F.sum("n_tokens")).first()[0]
    asked = F.col("target_share") / F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0))) * F.lit(float(total or 0))  # a row per target
    return mixing.shares(pages, targets, mixing.mix(pages, targets, total)).withColumn("short_tokens", F.round(F.greatest(F.lit(0.0), asked - F.col("used_tokens"))).cast("bigint"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(table(spark, d, "documents"))


def p10_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each page that an earlier page has too: what keeping first copies only removes."""
    return spans.covered(spans.windows(table(spark, d, "documents"))).where("repeated_chars > 0")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Characters in runs of three sentences that stand elsewhere too, and in those that are not the first of their kind."""
    return spans.sentence_spans(table(spark, d, "documents"))


_PAIRS = """
WITH u AS (
  SELECT DISTINCT 'column_reads' origin, request_id r, e.key dataset, lower(c) item FROM (
    SELECT request_id, e, unnest(e.value) c FROM (SELECT request_id, unnest(map_entries(column_reads)) e FROM audit)) WHERE c <> ''
  UNION
  SELECT DISTINCT 'subjects', request_id, regexp_extract(s, '^column:(.*)\\.[^.]*$', 1), lower(regexp_extract(s, '([^.]*)$', 1))
  FROM (SELECT request_id, unnest(subjects) s FROM audit) WHERE s LIKE 'column:%.%' AND s NOT LIKE '%.'),
n AS (SELECT origin, dataset, count(DISTINCT r) n_records FROM u GROUP BY ALL),
i AS (SELECT origin, dataset, item, count(*) n FROM u GROUP BY ALL),
p AS (SELECT a.origin, a.dataset, a.item column_a, b.item column_b, count(*) n_ab
  FROM u a JOIN u b ON a.origin = b.origin AND a.dataset = b.dataset AND a.r = b.r AND a.item < b.item GROUP BY ALL HAVING count(*) >= 5),
f AS (SELECT p.origin, p.dataset, column_a, column_b, n_ab, x.n n_a, y.n n_b, n_records
  FROM p JOIN n USING (origin, dataset) JOIN i x ON x.origin = p.origin AND x.dataset = p.dataset AND x.item = column_a
  JOIN i y ON y.origin = p.origin AND y.dataset = p.dataset AND y.item = column_b)
"""

_FORMS = """
WITH raw AS (
  SELECT 'original_sql' origin, 0::BIGINT rec_id, line_no no, original_sql s FROM audit WHERE original_sql IS NOT NULL
  UNION ALL SELECT 'by_sql', usage_id, i - 1, x.stmt FROM (SELECT usage_id, unnest(by_sql) x, generate_subscripts(by_sql, 1) i FROM day_usage) WHERE x.stmt IS NOT NULL),
a AS (SELECT origin, rec_id, no, regexp_replace(array_to_string(list_transform(string_split(s, chr(39)), lambda x, i: CASE WHEN i % 2 = 1 THEN trim(
  regexp_replace(regexp_replace(regexp_replace(lower(x), '["`]', '', 'g'), '\\s+', ' ', 'g'), ' ?([^\\w\\s]) ?', '\\1', 'g')) ELSE x END), chr(39)), '[; ]+$', '') t FROM raw),
b AS (SELECT *, regexp_extract(t, '^select (?:distinct )?(.*?)\\bfrom\\b', 1) items FROM a),
c AS (SELECT origin, rec_id, no, CASE WHEN items = '' THEN t ELSE replace(t, items, '#' || array_to_string(list_sort(list_transform(string_split(items, ','), lambda z: trim(z))), ',') || '#') END form FROM b),
g AS (SELECT origin, rec_id, form, min(no) first_no, count(*) n FROM c GROUP BY ALL)
"""

SQL = {
    "p2_found": _FORMS + "SELECT origin, rec_id, first_no, no AS copy_no FROM c JOIN g USING (origin, rec_id, form) WHERE no <> first_no",
    "p2_collisions": _FORMS + "SELECT count(*) AS n_collisions FROM (SELECT md5(form) FROM c GROUP BY 1 HAVING min(form) <> max(form))",
    "p2_records": _FORMS + "SELECT origin, rec_id, first_no, n AS n_copies FROM g",
    "p10_found": """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)),
m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM w SEMI JOIN m USING (h))
SELECT doc_id, sum(least(200, coalesce(i - p, 200)))::BIGINT AS shared_chars FROM s GROUP BY doc_id
""",
    "p10_repeated": """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)),
m AS (SELECT h, min(doc_id) f FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, i, f, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p,
  max(CASE WHEN f < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) q FROM w JOIN m USING (h))
SELECT doc_id, sum(least(200, coalesce(i - p, 200)))::BIGINT AS shared_chars, sum(CASE WHEN f < doc_id THEN least(200, coalesce(i - q, 200)) END)::BIGINT AS repeated_chars
FROM s GROUP BY doc_id HAVING count(CASE WHEN f < doc_id THEN 1 END) > 0
""",
    "p3_found": _PAIRS + "SELECT origin, dataset, column_a, column_b FROM f WHERE n_ab * n_records >= 2 * n_a * n_b",
    "p3_scores": _PAIRS + "SELECT *, (n_ab * n_records)::DOUBLE / (n_a * n_b)::DOUBLE AS lift FROM f",
    "p10_sentences": """
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+[ \\n\\t\\r]*|[^.!?]+\\z') s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
r AS (SELECT doc_id, i, md5(s[i + 1] || s[i + 2] || s[i + 3]) h FROM (SELECT doc_id, s, unnest(range(0, len(s) - 2)) i FROM p)),
g AS (SELECT h, min({'d': doc_id, 'i': i}) f, max(doc_id) l FROM r GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, j, bool_or(elsewhere) elsewhere, bool_or(later) later FROM (
  SELECT doc_id, unnest(range(i, i + 3)) j, f.d <> l elsewhere, f <> {'d': doc_id, 'i': i} later FROM r JOIN g USING (h)) GROUP BY 1, 2)
SELECT m.doc_id, max(len(s)) AS n_sentences, coalesce(sum(length(s[j + 1])) FILTER (elsewhere), 0)::BIGINT AS shared_chars, coalesce(sum(length(s[j + 1])) FILTER (later), 0)::BIGINT AS repeated_chars
FROM m JOIN p ON p.doc_id = m.doc_id GROUP BY 1
""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_records, p2_collisions, p3_found, p3_scores, p8_found, p8_items, p8_reworded, p9_mix, p9_shares, p9_capped, p10_found, p10_repeated, p10_sentences)}
