"""Sensitive fields anywhere in a JSON payload.

The outermost objects with a ``$sensitive`` key are taken out with their paths,
sealed or opened as columns (``shred``), and put back. Only the walk over
arbitrary JSON is Python; keys meet values by a join, and ciphers run in the JVM.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import shred

MARK = "$sensitive"
FOUND = "array<struct<path:string,state:string,subject:string,value:string,algorithm:string>>"


def walk(node: Any, path: list | None = None):
    path = path or []
    if isinstance(node, dict):
        if MARK in node:
            yield path, node
            return
        for k, v in node.items():
            yield from walk(v, [*path, k])
    elif isinstance(node, list):
        for k, v in enumerate(node):
            yield from walk(v, [*path, k])


def taken(payload: str | None) -> list[dict]:
    out = []
    for path, node in walk(json.loads(payload)) if payload else ():
        value = node.get("ciphertext") if node[MARK] == "sealed" else json.dumps(node["value"]) if node[MARK] == "plain" else None
        out.append(
            {
                "path": json.dumps(path),
                "state": node[MARK],
                "subject": node.get("subject"),
                "value": value,
                "algorithm": node.get("algorithm"),
            }
        )
    return out


def put_back(payload: str | None, fields: list | None) -> str | None:
    if payload is None or fields is None or len(fields) == 0:
        return payload
    root = json.loads(payload)
    for f in fields:
        if f["state"] == "sealed":
            new = {MARK: "sealed", "algorithm": f["algorithm"], "subject": f["subject"], "ciphertext": f["value"]}
        elif f["state"] == "plain":
            new = {MARK: "plain", "subject": f["subject"], "value": json.loads(f["value"])}
        else:
            new = {MARK: "shredded"}
        path, at = json.loads(f["path"]), root
        if not path:
            root = new
            continue
        for step in path[:-1]:
            at = at[step]
        at[path[-1]] = new
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))


def _through(rows: DataFrame, keys: DataFrame, key: str, change, column: str) -> DataFrame:
    @F.pandas_udf(FOUND)
    def find(payload: pd.Series) -> pd.Series:
        return payload.map(taken)

    @F.pandas_udf("string")
    def replace(payload: pd.Series, fields: pd.Series) -> pd.Series:
        return pd.Series([put_back(p, f) for p, f in zip(payload, fields, strict=True)], dtype=object)

    each = rows.select(key, F.explode(find(column)).alias("f")).select(
        key,
        "f.path",
        F.struct("f.state", "f.subject", "f.value", "f.algorithm").alias("field"),
    )
    changed = change(each, keys, "field").groupBy(key).agg(
        F.collect_list(F.struct("path", "field.state", "field.subject", "field.value", "field.algorithm")).alias("fields_")
    )
    return rows.join(changed, key, "left").withColumn(column, replace(column, "fields_")).select(*rows.columns)


def sealed(rows: DataFrame, keys: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """rows: key (unique) and a column of JSON, among others. Every plain field is sealed."""
    return _through(rows, keys, key, shred.sealed, column)


def opened(rows: DataFrame, keys: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """Every sealed field is opened, or shredded where its subject has no key."""
    return _through(rows, keys, key, shred.opened, column)


def subjects(rows: DataFrame, column: str = "payload") -> DataFrame:
    """The subjects of plain fields, which need keys."""

    @F.pandas_udf(FOUND)
    def find(payload: pd.Series) -> pd.Series:
        return payload.map(taken)

    return rows.select(F.explode(find(column)).alias("f")).where("f.state = 'plain'").select("f.subject").distinct()
