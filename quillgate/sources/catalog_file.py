"""Catalog facts from a YAML file.

    datasets:
      - name: db.users
        platform: spark
        domain: Marketing
        owners: [data-eng]
        certified: true
        deprecated: false
        replaced_by: db.users_v2
        columns:
          - {name: email, type: VARCHAR, tags: [PII], terms: [], derives_from: [db.raw.email]}

Gives the same tables as the catalog's fact feeds, so every policy operator
takes either. Errors name the field at fault.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


class CatalogError(ValueError):
    pass


def _need(ok: bool, where: str, what: str) -> None:
    if not ok:
        raise CatalogError(f"{where}: {what}")


def parse(text: str) -> dict[str, Any]:
    """The checked content of a catalog file."""
    import yaml

    doc = yaml.safe_load(text)
    _need(isinstance(doc, dict) and isinstance(doc.get("datasets"), list) and bool(doc["datasets"]), "datasets", "a list with at least one data set is needed")
    names: set[str] = set()
    for i, ds in enumerate(doc["datasets"]):
        at = f"datasets[{i}]"
        _need(isinstance(ds, dict) and isinstance(ds.get("name"), str) and ds["name"] != "", f"{at}.name", "text is needed")
        _need(ds["name"] not in names, f"{at}.name", f"{ds['name']} is there twice")
        names.add(ds["name"])
        seen: set[str] = set()
        for j, c in enumerate(ds.get("columns") or []):
            _need(isinstance(c, dict) and isinstance(c.get("name"), str), f"{at}.columns[{j}].name", "text is needed")
            _need(c["name"].lower() not in seen, f"{at}.columns[{j}].name", f"{c['name']} is there twice")
            seen.add(c["name"].lower())
            for k in ("tags", "terms", "derives_from"):
                _need(isinstance(c.get(k) or [], list), f"{at}.columns[{j}].{k}", "a list is needed")
    for i, ds in enumerate(doc["datasets"]):
        to = ds.get("replaced_by")
        _need(to is None or to in names, f"datasets[{i}].replaced_by", f"{to} is no data set of this file")
    return doc


def load(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """datasets, columns, lineage and column_lineage of a catalog file."""
    doc = parse(text)
    urn = lambda ds: f"urn:li:dataset:(urn:li:dataPlatform:{ds.get('platform', 'spark')},{ds['name']},{ds.get('env', 'PROD')})"
    by_name = {ds["name"]: urn(ds) for ds in doc["datasets"]}
    sets, cols, edges, column_edges = [], [], [], []
    for ds in doc["datasets"]:
        u = urn(ds)
        life, cert = ("DEPRECATED" if ds.get("deprecated") else ""), ("CERTIFIED" if ds.get("certified") else "")
        sets.append((u, ds.get("platform", "spark"), ds["name"], ds.get("env", "PROD"), life, cert, ds.get("domain"), list(ds.get("owners") or []), list(ds.get("tags") or []), list(ds.get("terms") or [])))
        if ds.get("replaced_by"):
            edges.append((u, by_name[ds["replaced_by"]], 0))
        for c in ds.get("columns") or []:
            field = f"urn:li:schemaField:({u},{c['name']})"
            tags, terms = ([x.lower() for x in c.get(k) or []] for k in ("tags", "terms"))
            cols.append((field, u, c["name"], c.get("type", "VARCHAR"), tags, terms, ds["name"], ds.get("platform", "spark"), ds.get("domain")))
            for source in c.get("derives_from") or []:
                table, _, column = source.rpartition(".")
                _need(table in by_name, "derives_from", f"{source} is in no data set of this file")
                column_edges.append((field, f"urn:li:schemaField:({by_name[table]},{column})"))
    return {
        "datasets": spark.createDataFrame(sets, "urn string, platform string, name string, env string, lifecycle string, certification string, domain string, owners array<string>, tags array<string>, terms array<string>"),
        "columns": spark.createDataFrame(cols, "urn string, dataset_urn string, column string, data_type string, tags array<string>, terms array<string>, dataset string, platform string, domain string"),
        "lineage": spark.createDataFrame(edges, "src_urn string, dst_urn string, ord int"),
        "column_lineage": spark.createDataFrame(column_edges, "field_urn string, upstream_urn string"),
    }
