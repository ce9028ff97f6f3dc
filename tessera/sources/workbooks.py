"""Workbooks: XLSX files, their cells as rows, and the trees and edges that workbooks hold.

A capture is flat cells (doc_key, sheet_no, sheet, ref, value), one row per non-empty cell, so that any number of workbooks is
read in one job. Trees are (doc_key, ordinal, citation, citation_norm, kind, status, title, body, parent): parent is a
citation_norm of the same document, null for a root. ordinal is the sheet's row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.citations import cell_column, cell_row, title_key
from tessera.functions.text import labelled_body, withdrawal_action, withdrawal_targets

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
CELLS = "doc_key string, sheet_no int, sheet string, ref string, value string"


def workbook_cells(content: bytes, sheets: str = "") -> list[tuple[int, str, str, str]]:
    """(sheet's number, sheet, ref, value) of the non-empty cells, sheets in their order, rows from left to right; of sheets whose name holds the pattern, others are not parsed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for no, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)):
            if not re.search(sheets, sheet.get("name")):
                continue
            target = rels[sheet.get(f"{{{_NS['r']}}}id")]
            path = target if target.startswith("xl/") else f"xl/{target}"
            for cell in ElementTree.fromstring(z.read(path)).iter(f"{{{_NS['m']}}}c"):
                kind = cell.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                else:
                    v = cell.find("m:v", _NS)
                    value = "" if v is None or v.text is None else shared[int(v.text)] if kind == "s" else v.text
                if value.strip():
                    out.append((no, sheet.get("name"), cell.get("ref") or cell.get("r"), value))
        return out


def read_workbooks(spark, path: str, sheets: str = "") -> DataFrame:
    """Cells of all workbooks under a path, of sheets whose name holds the pattern, through Spark's binary files, so that any store will do and files are dealt over tasks. A file that is no workbook gives one row without a cell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)

    def cells(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for key, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(key, *cell) for cell in workbook_cells(content, sheets)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((key, None, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_key", "sheet_no", "sheet", "ref", "value"]).astype({"sheet_no": "Int32"})

    return files.select("path", "content").mapInPandas(cells, CELLS)


def grid(cells: DataFrame, columns: list[str], by: Sequence[str] = ()) -> DataFrame:
    """doc_key, sheet, further columns of cells, row and a trimmed text for each column; missing cells are empty."""
    placed = cells.filter("ref is not null").select("doc_key", "sheet", *by, cell_row(F.col("ref")).alias("row"), cell_column(F.col("ref")).alias("col"), "value")
    wide = placed.groupBy("doc_key", "sheet", *by, "row").pivot("col", columns).agg(F.first("value"))
    clean = lambda c: F.coalesce(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""), F.lit(""))
    return wide.select("doc_key", "sheet", *by, "row", *[clean(F.col(c)).alias(c) for c in columns])


def _tree(rows: DataFrame, citation: Column, kind: Column, title: Column, body: Column, parent: Column, status: Column | None = None) -> DataFrame:
    norm = F.upper(F.regexp_replace(citation, " ", ""))
    some = lambda c: F.when(c != "", c)
    return rows.select("doc_key", F.col("row").alias("ordinal"), citation.alias("citation"), norm.alias("citation_norm"), kind.alias("kind"), (status if status is not None else F.lit("active")).alias("status"), title.alias("title"), some(body).alias("body"), parent.alias("parent"))


def cis_tree(cells: DataFrame) -> DataFrame:
    """Controls, and safeguards under them: a row without column B is a control. Ids stay text, so 4.1 and 4.10 differ."""
    rows = grid(cells.filter(F.col("sheet").contains("Controls v8")), list("ABCDEFGHI")).filter("row > 1 and A <> ''")
    groups = F.concat_ws(", ", *[F.when(F.lower(F.col(c)) == "x", name) for c, name in (("G", "IG1"), ("H", "IG2"), ("I", "IG3"))])
    control = F.col("B") == ""
    body = F.when(control, F.col("F")).otherwise(labelled_body(F.col("F"), [("Asset Class", F.col("C")), ("Security Function", F.col("D")), ("Implementation Groups", groups)]))
    known = rows.filter("B = ''").select("doc_key", F.col("A").alias("__p")).distinct()
    held = rows.join(known, (rows["doc_key"] == known["doc_key"]) & (F.col("A") == F.col("__p")), "left").drop(known["doc_key"])
    return _tree(held, F.when(control, F.col("A")).otherwise(F.col("B")), F.when(control, "control").otherwise("safeguard"), F.col("E"), body, F.when(~control, F.col("__p")))


#: A domain's name and acronym, and the shapes of a crosswalk's two columns.
DOMAIN = r"\s-\s([A-Z][A-Z&]+)$"
CROSSWALK = (r"^[A-Z]{2}-\d{2}(\(\d{2}\))?$", r"^(A\.)?\d+(\.\d+)*$")


def ccm_tree(cells: DataFrame, sheet: str = "CCM", applicability: dict[str, str] | None = None) -> DataFrame:
    """Domains from `Name - ACR` rows, and controls under the last one above them. Rows from 4 on; others are passed over."""
    applicability = applicability or {}
    rows = grid(cells.filter(F.col("sheet").contains(sheet)), ["A", "B", "C", "D", *applicability]).filter("row >= 4")
    acronym = F.regexp_extract("A", DOMAIN, 1)
    domain = (F.col("A") != "") & (F.col("C") == "") & (acronym != "")
    last = Window.partitionBy("doc_key", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("__d", F.last(F.when(domain, acronym), ignorenulls=True).over(last)).filter(domain | (F.col("C") != ""))
    body = F.when(~domain, labelled_body(F.col("D"), [(label, F.col(c)) for c, label in applicability.items()])).otherwise("")
    title = F.when(domain, F.regexp_replace("A", DOMAIN, "")).otherwise(F.col("B"))
    return _tree(held, F.when(domain, acronym).otherwise(F.col("C")), F.when(domain, "domain").otherwise("control"), title, body, F.when(~domain, F.upper("__d")))


#: How functions, categories, subcategories and withdrawals are written.
CSF = {"function": r"^[A-Z]+\s+\(([A-Z]{2})\)(?::\s*(.+))?$", "category": r"^(.+?)\s+\(([A-Z]{2}\.[A-Z]{2,})\):\s*(.+)$", "subcategory": r"^([A-Z]{2}\.[A-Z]{2,}-\d+):\s*(.+)$", "withdrawn": r"^\[Withdrawn:\s*(.+)\]$"}


def csf_rows(cells: DataFrame, sheet: str = "CSF") -> DataFrame:
    """Rows of the core with kind, id, rest and note; a function listed twice counts once, where it is described."""
    rows = grid(cells.filter(F.col("sheet").contains(sheet)), list("ABCDE")).filter("row > 2")
    kind = F.when(F.col("A") != "", "function").when(F.col("B") != "", "category").when(F.col("C") != "", "subcategory")
    get = lambda c, name, k: F.regexp_extract(c, CSF[name], k)
    number = F.when(F.col("kind") == "function", get("A", "function", 1)).when(F.col("kind") == "category", get("B", "category", 2)).otherwise(get("C", "subcategory", 1))
    rest = F.when(F.col("kind") == "function", get("A", "function", 2)).when(F.col("kind") == "category", get("B", "category", 3)).otherwise(get("C", "subcategory", 2))
    held = rows.withColumn("kind", kind).filter("kind is not null").withColumns({"id": number, "rest": F.trim(rest)}).filter("id <> ''")
    first = F.row_number().over(Window.partitionBy("doc_key", "kind", "id").orderBy((F.col("rest") == "").cast("int"), "row"))
    held = held.withColumn("__n", F.when(F.col("kind") == "function", first).otherwise(1)).filter("__n = 1").drop("__n")
    return held.withColumn("note", F.regexp_extract("rest", CSF["withdrawn"], 1))


def csf_tree(cells: DataFrame, sheet: str = "CSF") -> DataFrame:
    """Functions, categories and subcategories. A withdrawn subcategory has neither title nor body, a withdrawn category its name."""
    held = csf_rows(cells, sheet)
    gone = (F.col("note") != "") & (F.col("kind") != "function")
    title = F.when(~gone, F.col("rest")).when(F.col("kind") == "category", F.regexp_extract("B", CSF["category"], 1)).otherwise("")
    body = F.when(~gone & (F.col("kind") == "subcategory"), F.concat_ws("\n\n", "rest", F.when(F.col("D") != "", F.col("D")))).otherwise("")
    parent = F.when(F.col("kind") == "category", F.substring("id", 1, 2)).when(F.col("kind") == "subcategory", F.regexp_replace("id", r"-[^-]*$", ""))
    ids = held.select("doc_key", F.col("id").alias("__p")).distinct()
    placed = held.withColumn("__w", parent).join(ids.withColumnRenamed("doc_key", "__k"), (F.col("doc_key") == F.col("__k")) & (F.col("__w") == F.col("__p")), "left")
    fallback = F.coalesce("__p", F.when(F.col("kind") == "subcategory", F.substring("id", 1, 2)))
    return _tree(placed, F.col("id"), F.col("kind"), title, body, fallback, F.when(gone, "withdrawn").otherwise("active"))


def csf_withdrawals(cells: DataFrame, sheet: str = "CSF") -> DataFrame:
    """doc_key, from_norm, to_citation_norm, relationship of withdrawn rows; free text gives none."""
    held = csf_rows(cells, sheet).filter("note <> '' and kind <> 'function'")
    return held.select("doc_key", F.col("id").alias("from_norm"), F.explode(withdrawal_targets(F.col("note"))).alias("to_citation_norm"), withdrawal_action(F.col("note")).alias("relationship"))


def crosswalk_edges(cells: DataFrame) -> DataFrame:
    """from_norm, to_norm, provenance of a crosswalk's shaped pairs, once each, from the lowest row of the first sheet."""
    rows = grid(cells.filter("sheet <> 'Definitions'"), ["A", "D"], by=["sheet_no"])
    shaped = rows.filter(F.col("A").rlike(CROSSWALK[0]) & F.col("D").rlike(CROSSWALK[1]))
    first = shaped.groupBy("doc_key", F.upper("A").alias("from_norm"), F.upper("D").alias("to_norm")).agg(F.min(F.struct("sheet_no", "row", "sheet")).alias("at"))
    return first.select("doc_key", "from_norm", "to_norm", F.concat(F.lit("sheet "), "at.sheet", F.lit(" row "), F.col("at.row").cast("string")).alias("provenance"))


#: Relations as a mapping workbook writes them; a blank one is `related`, others are passed over.
RELATIONS = {"equivalent": "equivalent", "subset": "subset-of", "superset": "superset-of"}


def mapping_edges(cells: DataFrame, safeguards: DataFrame, target) -> DataFrame:
    """from_id, to_norm, relationship, provenance: rows find their safeguard by title, since ids may be mangled numbers.

    safeguards: id, title, title_original. target: normalizes the target column; null drops the row.
    """
    rows = grid(cells.filter(F.col("sheet").startswith("All CIS")), ["F", "K", "L"]).filter("not (K = '' and L = '')")
    relation = F.when(F.col("K") == "", "related")
    for word, name in RELATIONS.items():
        relation = relation.when(F.lower("K") == word, name)
    held = rows.select("doc_key", "sheet", "row", title_key(F.col("F")).alias("key"), relation.alias("relationship"), target(F.col("L")).alias("to_norm")).filter("relationship is not null and to_norm is not null and key <> ''")
    keys = safeguards.select("id", F.explode(F.array_compact(F.array(title_key(F.col("title")), title_key(F.col("title_original"))))).alias("key")).groupBy("key").agg(F.min("id").alias("from_id"))
    found = held.join(keys, "key").groupBy("doc_key", "from_id", "to_norm", "relationship").agg(F.min(F.struct("sheet", "row")).alias("at"))
    return found.select("doc_key", "from_id", "to_norm", "relationship", F.concat(F.lit("sheet "), "at.sheet", F.lit(" row "), F.col("at.row").cast("string")).alias("provenance"))
