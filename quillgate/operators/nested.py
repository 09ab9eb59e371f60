"""Nested records into related flat tables (problem 1).

A catalog payload is a JSON tree whose writers changed its layout over time.
The shapes are told apart bottom-up by a small tree automaton: the state of a
node follows from its own kind and the states of its children
(``schema_of_variant`` supplies the kind of a leaf or list, so a state never
holds keys that are data). The state routes a node to the typed reading of
its subtype, and all subtypes share one supertype table with the record id,
the parent's key and their own key:

    label list   absent | null | empty | names | objects | mixed | bare | bare_object | other
    column       <listed|keyed>(tags, terms, editable)
    data set     <listed|keyed>(columns container)

``names`` are read as array<string>, ``objects`` as array<struct<urn, name>>,
``bare`` as string, ``bare_object`` as struct<urn, name>, and only ``mixed``
lists member by member. What no subtype takes (``other``: lists in lists) goes
to :func:`rejects` instead of vanishing.

Everything is JVM expressions over one scan of each table; only requests for
distinct labels shuffle. Defined results: an invalid, null or empty payload
gives no rows; members without a name or URN are left out of the tables below
them; null and empty labels are no labels; extra columns of the input are
ignored; repeated records repeat their rows (ids are expected to be unique).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgate.functions.columns import label_name


def _get(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _kind(node: Column) -> Column:
    """Leaf transition: SQL null (absent), VOID, STRING, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(node)


def _with_kind(node: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the node's kind, which is worked out once."""
    return F.element_at(F.transform(F.array(_kind(node)), use), 1)


def label_state(node: Column) -> Column:
    """State of a node that should hold labels."""
    return _with_kind(
        node,
        lambda k: F.when(k.isNull(), "absent")
        .when(k == "VOID", "null")
        .when(k == "ARRAY<VOID>", "empty")
        .when(k.startswith("ARRAY<OBJECT"), "objects")
        .when(k == "ARRAY<VARIANT>", "mixed")
        .when(k.startswith("ARRAY<ARRAY"), "other")
        .when(k.startswith("ARRAY<"), "names")
        .when(k.startswith("OBJECT"), "bare_object")
        .otherwise("bare"),
    )


NAMED = "struct<urn string, name string>"


def label_list(node: Column) -> Column:
    """The labels of a node as an array of raw texts, by the typed reading of its state."""

    def member(x: Column) -> Column:
        return _with_kind(
            x,
            lambda k: F.when(k.isNull() | (k == "VOID") | k.startswith("ARRAY"), F.lit(None).cast("string"))
            .when(k.startswith("OBJECT"), F.coalesce(_get(x, "$.urn", "string"), _get(x, "$.name", "string")))
            .otherwise(_get(x, "$", "string")),
        )

    named = lambda x: F.coalesce(x["urn"], x["name"])
    # The kinds in the order of label_state: none, objects, mixed, other, names, bare_object, bare.
    raw = _with_kind(
        node,
        lambda k: F.when(k.isNull() | (k == "VOID") | (k == "ARRAY<VOID>"), F.lit(None).cast("array<string>"))
        .when(k.startswith("ARRAY<OBJECT"), F.transform(_get(node, "$", f"array<{NAMED}>"), named))
        .when(k == "ARRAY<VARIANT>", F.transform(_get(node, "$", "array<variant>"), member))
        .when(k.startswith("ARRAY<ARRAY"), F.lit(None).cast("array<string>"))
        .when(k.startswith("ARRAY<"), _get(node, "$", "array<string>"))
        .when(k.startswith("OBJECT"), F.array(named(_get(node, "$", NAMED))))
        .otherwise(F.array(_get(node, "$", "string"))),
    )
    return F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _names(node: Column) -> Column:
    return F.filter(F.transform(label_list(node), label_name), lambda x: x != "")


def _members(node: Column, path: str, own: str) -> Column:
    """Children of a container as array<struct<key, keyed, node>>, whichever its layout."""
    listed = F.transform(
        _get(node, path, "array<variant>"),
        lambda x: F.struct(_get(x, f"$.{own}", "string").alias("key"), F.lit(False).alias("keyed"), x.alias("node")),
    )
    keyed = F.transform(
        F.map_entries(_get(node, path, "map<string,variant>")),
        lambda x: F.struct(x["key"].alias("key"), F.lit(True).alias("keyed"), x["value"].alias("node")),
    )
    return F.filter(F.coalesce(listed, keyed), lambda x: x["key"].isNotNull() & (x["key"] != ""))


def parsed(records: DataFrame, rec_id: str = "snap_id", payload: str = "payload") -> DataFrame:
    """rec_id and the payload as a variant; null where it is not valid JSON."""
    return records.select(F.col(rec_id).alias("rec_id"), F.try_parse_json(F.col(payload)).alias("doc"))


def datasets(records: DataFrame, rec_id: str = "snap_id", payload: str = "payload") -> DataFrame:
    """Supertype table of data sets: rec_id, urn, variant, scalars, label lists, columns.

    ``columns`` is an array of structs (name, variant, urn, data_type, tags,
    editable_tags, terms); labels come without their URN prefix.
    """
    rows = parsed(records, rec_id, payload).select("rec_id", F.explode(_members(F.col("doc"), "$.datasets", "urn")).alias("d"))
    n = F.col("d.node")

    def column(x: Column) -> Column:
        c = x["node"]
        tags, terms, edit = (_get(c, p, "variant") for p in ("$.tags", "$.terms", "$.editable.tags"))
        return F.struct(
            x["key"].alias("name"),
            F.concat(
                F.when(x["keyed"], "keyed(").otherwise("listed("),
                label_state(tags), F.lit(","), label_state(terms), F.lit(","), label_state(edit), F.lit(")"),
            ).alias("variant"),
            _get(c, "$.urn", "string").alias("urn"),
            _get(c, "$.data_type", "string").alias("data_type"),
            _names(tags).alias("tags"),
            _names(edit).alias("editable_tags"),
            _names(terms).alias("terms"),
        )

    ck = _kind(_get(n, "$.columns", "variant"))
    return rows.select(
        "rec_id",
        F.col("d.key").alias("urn"),
        F.concat(
            F.when(F.col("d.keyed"), "keyed(").otherwise("listed("),
            F.when(ck.isNull() | (ck == "VOID"), "none").when(ck.startswith("ARRAY"), "list").otherwise("map"),
            F.lit(")"),
        ).alias("variant"),
        *[_get(n, f"$.{x}", "string").alias(x) for x in ("platform", "name", "env", "lifecycle", "certification", "domain")],
        label_list(_get(n, "$.owners", "variant")).alias("owners"),
        _names(_get(n, "$.tags", "variant")).alias("tags"),
        _names(_get(n, "$.terms", "variant")).alias("terms"),
        F.transform(_members(n, "$.columns", "name"), column).alias("columns"),
    )


def columns(sets: DataFrame) -> DataFrame:
    """Flat columns of :func:`datasets`, each with its parent's URN."""
    return sets.select("rec_id", F.col("urn").alias("dataset_urn"), F.explode("columns").alias("c")).select(
        "rec_id", "dataset_urn", "c.name", "c.variant", "c.urn", "c.data_type", "c.tags", "c.editable_tags", "c.terms"
    )


def labels(cols: DataFrame) -> DataFrame:
    """Flat labels of :func:`columns`: rec_id, dataset_urn, column, kind, label."""
    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))

    kinds = F.flatten(F.array(*[of(k) for k in ("tags", "editable_tags", "terms")]))
    return cols.select("rec_id", "dataset_urn", F.col("name").alias("column"), F.explode(kinds).alias("l")).select(
        "rec_id", "dataset_urn", "column", "l.kind", "l.label"
    )


def edges(records: DataFrame, rec_id: str = "snap_id", payload: str = "payload") -> DataFrame:
    """Both lineage maps of the payloads: rec_id, graph, urn (the map's key), other, ord."""

    def of(graph: str) -> Column:
        return F.transform(
            F.coalesce(F.map_entries(_get(F.col("doc"), f"$.{graph}", "map<string,variant>")), F.array()),
            lambda e: F.struct(F.lit(graph).alias("graph"), e["key"].alias("urn"), label_list(e["value"]).alias("others")),
        )

    both = F.concat(of("lineage"), of("column_lineage"))
    return (
        parsed(records, rec_id, payload)
        .select("rec_id", F.explode(both).alias("e"))
        .select("rec_id", "e.graph", "e.urn", F.posexplode("e.others").alias("ord", "other"))
        .select("rec_id", "graph", "urn", "other", F.col("ord").cast("bigint").alias("ord"))
    )


def rejects(records: DataFrame, rec_id: str = "snap_id", payload: str = "payload") -> DataFrame:
    """rec_id, dataset_urn, column, path, schema of label nodes of a shape no subtype takes."""
    rows = parsed(records, rec_id, payload).select("rec_id", F.explode(_members(F.col("doc"), "$.datasets", "urn")).alias("d"))
    cols = rows.select("rec_id", F.col("d.key").alias("dataset_urn"), F.explode(_members(F.col("d.node"), "$.columns", "name")).alias("c"))
    nodes = F.array(*[F.struct(F.lit(p).alias("path"), _get(F.col("c.node"), p, "variant").alias("node")) for p in ("$.tags", "$.terms", "$.editable.tags")])
    flat = cols.select("rec_id", "dataset_urn", F.col("c.key").alias("column"), F.explode(nodes).alias("n"))
    return flat.where(label_state(F.col("n.node")) == "other").select("rec_id", "dataset_urn", "column", "n.path", _kind(F.col("n.node")).alias("schema"))


def verdicts(audit: DataFrame) -> DataFrame:
    """rec_id (line_no), ord, code, action, subject: one row per entry, null structs left out."""
    return (
        audit.select(F.col("line_no").alias("rec_id"), F.posexplode("verdicts").alias("ord", "v"))
        .where(F.col("v").isNotNull())
        .select("rec_id", "ord", "v.code", "v.action", "v.subject")
    )


def reads(audit: DataFrame) -> DataFrame:
    """rec_id (line_no), dataset_urn, column (lower case, distinct within the record's data set)."""
    cols = F.array_distinct(F.transform(F.col("r.value"), F.lower))
    return (
        audit.select(F.col("line_no").alias("rec_id"), F.explode(F.map_entries("column_reads")).alias("r"))
        .select("rec_id", F.col("r.key").alias("dataset_urn"), F.explode(cols).alias("column"))
        .where(F.col("column").isNotNull())
    )


def found(snapshots: DataFrame, audit: DataFrame) -> DataFrame:
    """All parent-child-leaf rows of the three sections, distinct.

    line_no and snap_id are unique, so verdicts and reads are made distinct
    inside their row, without a shuffle; only labels, which may meet again in
    another list of the same payload, are shuffled.
    """
    label_rows = (
        labels(columns(datasets(snapshots)))
        .select(
            F.lit("payload").alias("section"),
            "rec_id",
            F.col("dataset_urn").alias("parent"),
            F.col("column").alias("child"),
            F.col("label").alias("leaf"),
        )
        .distinct()
    )
    row = lambda section, parent, child, leaf: F.struct(F.lit(section).alias("section"), parent.alias("parent"), child.alias("child"), leaf.alias("leaf"))
    judged = F.array_distinct(F.transform(F.filter("verdicts", lambda v: v["code"].isNotNull()), lambda v: row("verdict", v["subject"], v["code"], v["action"])))
    columns_of = lambda r: F.filter(F.array_distinct(F.transform(r["value"], F.lower)), lambda c: c.isNotNull())
    read = F.flatten(F.transform(F.map_entries("column_reads"), lambda r: F.transform(columns_of(r), lambda c: row("read", r["key"], c, F.lit("")))))
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("section", "parent", "child", "leaf")])))
    audit_rows = audit.select(F.col("line_no").alias("rec_id"), F.explode(F.concat(F.coalesce(judged, none), F.coalesce(read, none))).alias("r"))
    return label_rows.unionByName(audit_rows.select("r.section", "rec_id", "r.parent", "r.child", "r.leaf"))


def content_hashes(hashed: DataFrame) -> DataFrame:
    """rec_id, content: one hash of all data sets of a record, whatever their order.

    ``hashed`` is (rec_id, urn, row_hash); a record's list is bounded by its payload.
    """
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", "urn", "row_hash")))
    return hashed.groupBy("rec_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("content"))
