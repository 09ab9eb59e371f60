import json

import pytest
from pyspark.sql import functions as F

from quillgate.operators import nested

AUDIT = "line_no bigint, verdicts array<struct<code: string, action: string, subject: string>>, column_reads map<string, array<string>>, section string"
URN = "urn:li:dataset:(urn:li:dataPlatform:p,db.s.t,PROD)"


def snapshots(spark, payloads):
    return spark.createDataFrame([(i + 1, p, "x") for i, p in enumerate(payloads)], "snap_id bigint, payload string, rec_id string")


def labels(spark, payload):
    rows = nested.labels(nested.columns(nested.datasets(snapshots(spark, [payload])))).collect()
    return sorted((r.dataset_urn, r.column, r.kind, r.label) for r in rows)


COLUMN = {"tags": ["urn:li:tag:PII", None, ""], "terms": {"urn": "urn:li:glossaryTerm:A.B"}, "editable": {"tags": [{"urn": "urn:li:tag:Gold", "actor": None}, "Plain"]}}
WANT = [(URN, "c", "editable_tags", "Gold"), (URN, "c", "editable_tags", "Plain"), (URN, "c", "tags", "PII"), (URN, "c", "terms", "A.B")]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("keyed_columns", [True, False])
def test_every_layout_gives_the_same_labels(spark, keyed, keyed_columns):
    ds = {"columns": {"c": COLUMN} if keyed_columns else [COLUMN | {"name": "c"}]}
    payload = {"datasets": {URN: ds} if keyed else [ds | {"urn": URN}]}
    assert labels(spark, json.dumps(payload)) == WANT


@pytest.mark.parametrize("payload", [None, "", "{", "[]", "3", "null", "{}", '{"datasets": null}', '{"datasets": 4}', '{"datasets": [null, 3, {}]}', '{"datasets": {"u": null}}', '{"datasets": {"u": {"columns": [null, {"tags": ["x"]}]}}}'])
def test_damaged_and_empty_payloads_give_no_labels(spark, payload):
    assert labels(spark, payload) == []


def test_single_label_and_null_states(spark):
    payload = {"datasets": {"u": {"columns": {"a": {"tags": "One"}, "b": {"tags": None}, "c": {"tags": []}, "d": {}, "e": {"tags": ["x", {"name": "y"}]}}}}}
    cols = {r.name: r for r in nested.columns(nested.datasets(snapshots(spark, [json.dumps(payload)]))).collect()}
    assert [cols[k].tags for k in "abcde"] == [["One"], [], [], [], ["x", "y"]]
    states = {k: cols[k].variant.split("(")[1].split(",")[0] for k in cols}
    assert states == {"a": "bare", "b": "null", "c": "empty", "d": "absent", "e": "mixed"}


def test_found_is_distinct_and_keeps_parents(spark):
    snaps = snapshots(spark, [json.dumps({"datasets": {"u": {"columns": {"c": {"tags": ["a", "a"], "terms": ["a"]}}}}})])
    audit = spark.createDataFrame(
        [(1, [("X", "mask", "s"), ("X", "mask", "s"), (None, "mask", "s"), None], {"u": ["A", "a", None], "v": []}, "z"), (2, None, None, "z"), (3, [], {"u": ["a"]}, "z")], AUDIT
    )
    rows = sorted(tuple(r) for r in nested.found(snaps, audit).collect())
    assert rows == [("payload", 1, "u", "c", "a"), ("read", 1, "u", "a", ""), ("read", 3, "u", "a", ""), ("verdict", 1, "s", "X", "mask")]


def test_empty_tables(spark):
    assert nested.found(snapshots(spark, []), spark.createDataFrame([], AUDIT)).count() == 0


def test_edges_and_long_payload(spark):
    payload = {"lineage": {"a": ["b", "c"]}, "column_lineage": {"x": ["y"]}, "datasets": {"u": {"columns": {f"c{i}": {"tags": ["t" * 200]} for i in range(3000)}}}}
    s = snapshots(spark, [json.dumps(payload)])
    assert sorted((r.graph, r.urn, r.other, r.ord) for r in nested.edges(s).collect()) == [("column_lineage", "x", "y", 0), ("lineage", "a", "b", 0), ("lineage", "a", "c", 1)]
    assert nested.columns(nested.datasets(s)).agg(F.count("*")).first()[0] == 3000


def test_lists_in_lists_are_rejected_not_lost(spark):
    payload = '{"datasets": {"u": {"columns": [{"name": "a", "tags": [["x"]], "terms": ["t"]}, {"name": "b", "tags": [{"urn": "urn:li:tag:y"}, {"name": "z"}], "editable": {"tags": {"name": "w"}}}]}}}'
    snaps = spark.createDataFrame([(1, payload), (2, "{"), (3, None)], "snap_id bigint, payload string")
    assert [tuple(r) for r in nested.rejects(snaps).collect()] == [(1, "u", "a", "$.tags", "ARRAY<ARRAY<STRING>>")]
    got = sorted((r.column, r.kind, r.label) for r in nested.labels(nested.columns(nested.datasets(snaps))).collect())
    assert got == [("a", "terms", "t"), ("b", "editable_tags", "w"), ("b", "tags", "y"), ("b", "tags", "z")]
