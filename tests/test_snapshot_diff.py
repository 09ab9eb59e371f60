import json

from quillgate.operators import snapshot_diff

SCHEMA = "snap_id bigint, source_url string, compiled_at string, payload string, seq int"


def changes(spark, rows):
    df = spark.createDataFrame([(i, s, t, p if isinstance(p, (str, type(None))) else json.dumps(p), 0) for i, s, t, p in rows], SCHEMA)
    return sorted(tuple(r) for r in snapshot_diff.changes(df).collect())


def sets(**d):
    return {"datasets": d}


def test_added_removed_changed(spark):
    rows = [
        (5, "s", "2020-01-03T00:00:00Z", sets(a={"lifecycle": "Draft"}, c={})),
        (1, "s", "2020-01-01T00:00:00Z", sets(a={"lifecycle": " draft "}, b={})),
        (2, "s", "2020-01-01T02:00:00+02:00", sets(z={})),  # the same instant: one snapshot, named 1
        (3, "s", "2020-01-02T00:00:00Z", "{not json"),
        (4, "s", "2020-01-02T12:00:00Z", sets(a={"lifecycle": "ACTIVE"}, b={})),
        (6, "other", "2020-01-04T00:00:00Z", sets(a={})),
        (7, "s", None, sets(q={})),
        (8, "s", "unknown", sets(q={})),
    ]
    assert changes(spark, rows) == [(4, "a", "changed"), (5, "a", "changed"), (5, "b", "removed"), (5, "c", "added")]


def test_layout_order_and_blanks_do_not_count(spark):
    one = sets(u={"owners": ["a", "b"], "tags": ["urn:li:tag:T"], "domain": "", "columns": [{"name": "x", "data_type": "INT", "tags": ["P"], "editable": {"tags": ["Q"]}}, {"name": "y"}]})
    two = {"datasets": [{"urn": "u", "owners": ["b", "a", "a"], "tags": {"urn": "T"}, "terms": None, "lifecycle": " ", "columns": {"y": {"tags": []}, "x": {"data_type": "INT", "tags": [{"urn": "urn:li:tag:Q"}, "P"]}}}]}
    three = sets(u={"owners": ["a", "b"], "tags": ["T"], "columns": [{"name": "x", "data_type": "INT", "tags": ["P"]}, {"name": "y"}]})
    rows = [(1, "s", "2020-01-01T00:00:00Z", one), (2, "s", "2020-01-02T00:00:00Z", two), (3, "s", "2020-01-03T00:00:00Z", three)]
    assert changes(spark, rows) == [(3, "u", "changed")]


def test_long_histories_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(snapshot_diff, "BLOCK", 4)
    rows, want = [], []
    for i in range(1, 40):
        d = ({"a": {"domain": str(i // 3)}} if i % 7 else {}) | {"k": {}}
        rows.append((i, "s", f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}T00:00:00Z", sets(**d)))
        if i > 1:
            now, before = i % 7 != 0, (i - 1) % 7 != 0
            if now and not before:
                want.append((i, "a", "added"))
            elif before and not now:
                want.append((i, "a", "removed"))
            elif now and i // 3 != (i - 1) // 3:
                want.append((i, "a", "changed"))
    assert changes(spark, rows) == sorted(want)


def test_empty_table(spark):
    assert changes(spark, []) == []
