"""Control catalogs in JSON, whose controls and parts nest to any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROWS = "doc_key string, row_type string, ordinal int, citation string, citation_norm string, kind string, status string, title string, body string, parent string, to_citation_norm string, relationship string, provenance string, error string"
_COLUMNS = [c.strip().split()[0] for c in ROWS.split(",")]
_INSERT = re.compile(r"\{\{ insert: param, (.*?) \}\}")


def _norm(label: str) -> str:
    return label.replace(" ", "").upper()


def _label(node: dict, default: str) -> str:
    return next((p["value"] for p in node.get("props", []) if p.get("name") == "label" and not p.get("class")), None) or next((p["value"] for p in node.get("props", []) if p.get("name") == "label"), default)


def _parameter(name: str, known: dict[str, dict]) -> str:
    p = known.get(name.strip(), {})
    select = p.get("select") or {}
    if select.get("choice"):
        many = " (one or more)" if select.get("how-many") == "one-or-more" else ""
        return f"[Selection{many}: {'; '.join(select['choice'])}]"
    return f"[Assignment: {p.get('label') or name.strip()}]"


def _prose(part: dict, known: dict[str, dict], indent: str = "") -> list[str]:
    own = [indent + _INSERT.sub(lambda m: _parameter(m[1], known), part["prose"])] if part.get("prose") else []
    return own + [line for sub in part.get("parts", []) for line in _prose(sub, known, indent + "  ")]


def catalog_rows(doc_key: str, text: str | None) -> Iterator[dict]:
    """Rows of one catalog, in document order: controls, edges of withdrawn ones, links that lead nowhere; or one error."""
    try:
        catalog = json.loads(text or "")["catalog"]
        groups = catalog["groups"]
        if not catalog["metadata"]["title"] or groups is None:
            raise KeyError("title or groups")
    except (ValueError, KeyError, TypeError) as e:
        yield {"doc_key": doc_key, "row_type": "error", "error": f"no catalog: {e}"}
        return
    labels, parameters = {}, {p["id"]: p for p in catalog.get("params", [])}
    stack = [(g, True) for g in groups]
    while stack:  # ids and parameters are known before any text is rendered
        node, group = stack.pop()
        labels[node.get("id")] = _label(node, node.get("id", "").upper())
        parameters.update((p["id"], p) for p in node.get("params", []))
        stack += [(c, False) for c in node.get("controls", [])]
    todo = [(g, "family", None) for g in reversed(groups)]
    ordinal = 0
    while todo:
        node, kind, parent = todo.pop()
        label = labels[node.get("id")]
        status = "withdrawn" if any(p.get("name") == "status" and p.get("value") == "withdrawn" for p in node.get("props", [])) and kind != "family" else "active"
        texts = ["\n".join(_prose(p, parameters)) for p in node.get("parts", []) if p.get("name") in ("statement", "guidance")]
        body = "\n\n".join(t for t in texts if t) or None
        row = {"doc_key": doc_key, "citation": label, "citation_norm": _norm(label)}
        yield row | {"row_type": "control", "ordinal": ordinal, "kind": kind, "status": status, "title": node.get("title", ""), "body": None if kind == "family" else body, "parent": parent}
        ordinal += 1
        for link in node.get("links", []) if status == "withdrawn" else []:
            if link.get("rel") in ("incorporated-into", "moved-to"):
                found = labels.get(link["href"].removeprefix("#").partition("_")[0])
                yield row | {"row_type": "edge" if found else "unresolved", "to_citation_norm": found and _norm(found), "relationship": link["rel"], "provenance": link["href"]}
        todo += [(c, "control" if kind == "family" else "enhancement", _norm(label)) for c in reversed(node.get("controls", []))]


def parse_catalogs(captures: DataFrame) -> DataFrame:
    """Rows of all catalogs. captures: doc_key, content. A capture is one document and fits a task."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for key, text in zip(batch["doc_key"], batch["content"]) for r in catalog_rows(key, text)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"ordinal": "Int32"}).astype(object).where(lambda d: d.notna(), None)

    return captures.select("doc_key", "content").mapInPandas(parse, ROWS)


def read_catalogs(spark, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).selectExpr("_metadata.file_path as doc_key", "value as content")
    return parse_catalogs(files)
