import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.functions.citations import csf_target
from tessera.sources import catalogs, iso, pages, workbooks


def cells(spark, sheet, rows):
    return spark.createDataFrame([("doc", 0, sheet, ref, value) for ref, value in rows.items()], workbooks.CELLS)


def test_workbook_file(spark, tmp_path):
    buffer = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>4.10</v></c><c r="C1"/></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buffer.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = workbooks.read_workbooks(spark, str(tmp_path)).collect()
    assert {(r.sheet, r.ref, r.value) for r in got} == {("One", "A1", "hello"), ("One", "B1", "4.10"), (None, None, None)}
    assert workbooks.read_workbooks(spark, str(tmp_path), "^T").filter("ref is not null").count() == 0


def test_cis_tree(spark):
    rows = {"A1": "head", "A2": "4", "E2": "Secure things", "F2": "All of it", "A3": "4", "B3": "4.1", "C3": "Devices", "E3": "First", "F3": "Do so", "G3": "x", "I3": "X", "A4": "4 ", "B4": "4.10", "E4": "Tenth"}
    got = {r.citation: r for r in workbooks.cis_tree(cells(spark, "Controls v8.1", rows)).collect()}
    assert got["4"].kind == "control" and got["4"].body == "All of it" and got["4"].parent is None
    assert got["4.1"].parent == "4" and got["4.1"].body == "Do so\n\nAsset Class: Devices\nImplementation Groups: IG1, IG3"
    assert got["4.10"].parent == "4" and got["4.10"].body is None


def test_ccm_tree(spark):
    rows = {"A1": "preamble", "A4": "Audit & Assurance - A&A", "B5": "Policy", "C5": "A&A-01", "D5": "Have one", "A6": "End of Standard"}
    got = {r.citation: r for r in workbooks.ccm_tree(cells(spark, "CCM", rows)).collect()}
    assert set(got) == {"A&A", "A&A-01"} and got["A&A"].title == "Audit & Assurance" and got["A&A-01"].parent == "A&A"


def test_csf(spark):
    rows = {"A3": "GOVERN (GV)", "A4": "GOVERN (GV): Watch over risk", "B5": "Context (GV.OC): What surrounds us", "C6": "GV.OC-01: Mission is known", "D6": "Ex1: say it", "C7": "GV.OC-02: [Withdrawn: Incorporated into GV.OC-01, GV.RM]", "B8": "Old (GV.XX): [Withdrawn: Moved into GV.OC]"}
    sheet = cells(spark, "CSF 2.0", rows)
    got = {r.citation: r for r in workbooks.csf_tree(sheet).collect()}
    assert got["GV"].title == "Watch over risk" and got["GV.OC"].parent == "GV" and got["GV.OC-01"].parent == "GV.OC"
    assert got["GV.OC-01"].body == "Mission is known\n\nEx1: say it"
    assert got["GV.OC-02"].status == "withdrawn" and got["GV.OC-02"].title == "" and got["GV.XX"].title == "Old"
    edges = {(r.from_norm, r.to_citation_norm, r.relationship) for r in workbooks.csf_withdrawals(sheet).collect() if "-" in r.to_citation_norm}
    assert edges == {("GV.OC-02", "GV.OC-01", "incorporated-into")}


def test_crosswalks(spark):
    rows = {"A2": "AC-01", "D2": "A.5.1", "A3": "AC-01", "D3": "A.5.1", "A4": "prose", "D4": "5.2", "A5": "AC-02(01)", "D5": "7.5.1"}
    got = {(r.from_norm, r.to_norm, r.provenance) for r in workbooks.crosswalk_edges(cells(spark, "Map", rows)).collect()}
    assert got == {("AC-01", "A.5.1", "sheet Map row 2"), ("AC-02(01)", "7.5.1", "sheet Map row 5")}
    two = cells(spark, "Zeta", {"A9": "AC-01", "D9": "5.2"}).unionByName(cells(spark, "Alpha", {"A1": "AC-01", "D1": "5.2"}).withColumn("sheet_no", F.lit(1)))
    assert [r.provenance for r in workbooks.crosswalk_edges(two).collect()] == ["sheet Zeta row 9"]  # the first in the workbook's order
    rows = {"F1": "t", "K1": "Relationship", "L1": "Target", "F2": "First  Thing", "K2": "Subset", "L2": "PR.AA-01", "F3": "first thing", "L3": "PR.AA-02", "F4": "First Thing", "K4": "odd", "L4": "PR.AA-03", "F5": "First Thing", "L5": "??"}
    known = spark.createDataFrame([(7, "first thing", None)], "id long, title string, title_original string")
    got = {(r.from_id, r.to_norm, r.relationship) for r in workbooks.mapping_edges(cells(spark, "All CIS x", rows), known, csf_target).collect()}
    assert got == {(7, "PR.AA-01", "subset-of"), (7, "PR.AA-02", "related")}


def test_catalog(spark):
    prop = lambda v: {"name": "label", "value": v}
    deep = {"id": "ac-2.1.1", "title": "Deeper", "props": [prop("AC-2(1)(1)")], "parts": []}
    gone = {"id": "ac-3", "title": "Gone", "props": [prop("AC-3"), {"name": "status", "value": "withdrawn"}], "links": [{"rel": "incorporated-into", "href": "#ac-2_smt.a"}, {"rel": "moved-to", "href": "#zz-9"}]}
    control = {"id": "ac-2", "title": "Accounts", "props": [prop("AC-2")], "params": [{"id": "p1", "label": "days"}, {"id": "p2", "select": {"how-many": "one-or-more", "choice": ["a", "b"]}}], "parts": [{"name": "statement", "prose": "Within {{ insert: param, p1 }}:", "parts": [{"name": "item", "prose": "{{ insert: param, p2 }} or {{ insert: param, p9 }}"}]}, {"name": "guidance", "prose": "Think."}], "controls": [{"id": "ac-2.1", "title": "Sub", "props": [prop("AC-2(1)")], "controls": [deep]}]}
    text = json.dumps({"catalog": {"metadata": {"title": "T"}, "groups": [{"id": "ac", "title": "Access", "props": [prop("AC")], "controls": [control, gone]}]}})
    rows = catalogs.parse_catalogs(spark.createDataFrame([("k", text), ("bad", "{"), ("none", None)], "doc_key string, content string")).collect()
    tree = sorted((r.ordinal, r.citation, r.kind, r.parent) for r in rows if r.row_type == "control")
    assert tree == [(0, "AC", "family", None), (1, "AC-2", "control", "AC"), (2, "AC-2(1)", "enhancement", "AC-2"), (3, "AC-2(1)(1)", "enhancement", "AC-2(1)"), (4, "AC-3", "control", "AC")]
    body = next(r.body for r in rows if r.citation == "AC-2" and r.row_type == "control")
    assert body == "Within [Assignment: days]:\n  [Selection (one or more): a; b] or [Assignment: p9]\n\nThink."
    assert [(r.to_citation_norm, r.relationship) for r in rows if r.row_type == "edge"] == [("AC-2", "incorporated-into")]
    assert [r.provenance for r in rows if r.row_type == "unresolved"] == ["#zz-9"] and len([r for r in rows if r.row_type == "error"]) == 2


def test_page_trees(spark):
    doc = [("d", 1, "7\n1.1 Keep a wall\nbody one\n1.1.1 Review the wall\nmore of it\nPurpose\nnot body"), ("d", 2, "1.1.1 (continued)\nlate words\n1.1.1.a Look at it\n1.2 Watch")]
    got = {r.citation: r for r in pages.page_tree(spark.createDataFrame(doc, "doc_key string, page int, text string"), pages.SCHEMES["pci-requirement"]).collect()}
    assert set(got) == {"1.1", "1.1.1", "1.2"} and got["1.1.1"].parent == "1.1" and got["1.1.1"].body == "Review the wall\nmore of it" and got["1.1"].body == "Keep a wall\nbody one"
    doc = [("d", 1, "Management Objective: APO01 Managed things\nAPO01.01 Do it\nwell\nActivities 1\n1. act")]
    got = {r.citation: r for r in pages.page_tree(spark.createDataFrame(doc, "doc_key string, page int, text string"), pages.SCHEMES["cobit-objective"]).collect()}
    assert got["APO01"].parent == "APO" and got["APO01.01"].parent == "APO01" and got["APO01.01"].body == "Do it\nwell" and got["APO"].kind == "domain"
    doc = [("d", 1, "ADDITIONAL CRITERIA PI1.1 The entity defines\n• Lead In [C] — what it is\n• Only text\nP1.0 Head\nP1.1 Notice")]
    tree = pages.page_tree(spark.createDataFrame(doc, "doc_key string, page int, text string"), pages.SCHEMES["tsc-criteria"])
    assert {r.citation for r in tree.collect()} == {"PI1.1", "P1.1"}
    points = {r.citation: r for r in pages.focus_points(tree).collect()}
    assert points["PI1.1-pof-01"].title_original == "Lead In" and points["PI1.1-pof-02"].body == "Only text"
    doc = [("d", 1, "4.1\nReplace the text\n9.9\nAdd more detail\nA.5.7\nDelete this")]
    got = {(r.citation, r.action) for r in pages.amendments(spark.createDataFrame(doc, "doc_key string, page int, text string")).collect()}
    assert got == {("4.1", "replace"), ("A.5.7", "delete")}


def read_pages(spark, lines, scheme):
    doc = [("d", k + 1, text) for k, text in enumerate(lines)]
    return {r.citation: r for r in pages.page_tree(spark.createDataFrame(doc, "doc_key string, page int, text string"), pages.SCHEMES[scheme]).collect()}


def test_ids_within_a_line(spark):
    lines = ["1.1 Group\n1.1.1 First text. 1.1.2 Second text.\n1.1.3 Third", "2.1.1 Alone (see 2.1.2 there)\nversion 9.8.7 of it\n2.1.3 More 1.1.3 again"]
    got = read_pages(spark, lines, "pci-requirement")
    assert set(got) == {"1.1", "1.1.1", "1.1.2", "1.1.3", "2.1.1", "2.1.3"}
    assert got["1.1.2"].parent == "1.1" and got["1.1.1"].body == "First text." and "9.8.7" in got["2.1.1"].body and got["2.1.3"].body == "More 1.1.3 again"


def read_iso(spark, texts, framework):
    doc = [("d", page, text) for page, text in texts.items()]
    return [tuple(r)[1:] for r in iso.iso_tree(spark.createDataFrame(doc, "doc_key string, page int, text string"), framework).orderBy("ordinal").collect()]


def test_clauses_and_annex_are_one_tree(spark):
    texts = {
        3: "4 Context ........ 7\n4.1 Understanding ...... 8", 5: "ISO/IEC 27001:2022(E)\n12\n4 Context\n4.1 Understanding it\nThe first text.\n3.9 is no clause\n4.1 Understanding it\n11.2 nor this", 6: "6.1.3 Treatment\nsteps\nAll rights reserved\n6 Planning\n10 Improvement",
        9: "Table A.1 is named here\n5.1 Leadership", 14: "Table A.1 - Controls\n8 Technological\n8.10 Deletion Control\n8.2 Access rights Control\n5 Organizational controls\n5.1.1 no control", 15: "7.1 on a page without the table", 16: "Table A.1 (continued)\n5.12 Classification of it Control\n9.1 no theme\n5.12 again",
    }
    assert read_iso(spark, texts, "iso27001") == [
        (0, "4", "4", "clause", "active", "Clause 4", None, None),
        (1, "4.1", "4.1", "clause", "active", "Clause 4.1", "The first text.\n3.9 is no clause\n4.1 Understanding it\n11.2 nor this", "4"),
        (2, "6.1.3", "6.1.3", "clause", "active", "Clause 6.1.3", "steps", None),
        (3, "6", "6", "clause", "active", "Clause 6", None, None),
        (4, "10", "10", "clause", "active", "Clause 10", None, None),
        (5, "5.1", "5.1", "clause", "active", "Clause 5.1", None, None),
        (6, "A.5", "A.5", "domain", "active", "Annex A theme A.5", None, None),
        (7, "A.5.12", "A.5.12", "annex-control", "active", "Annex A control A.5.12", "Classification of it Control", "A.5"),
        (8, "A.8", "A.8", "domain", "active", "Annex A theme A.8", None, None),
        (9, "A.8.2", "A.8.2", "annex-control", "active", "Annex A control A.8.2", "Access rights Control", "A.8"),
        (10, "A.8.10", "A.8.10", "annex-control", "active", "Annex A control A.8.10", "Deletion Control", "A.8"),
    ]


def test_control_catalogues(spark):
    got = read_iso(spark, {1: "5 Organizational controls\nabout it\n5.1 Policies\nControl type\n#Preventive #Corrective\nControl\nThe text.\n5.1.2 Not a control\n9.1 nor this\n8.34 Last ... 12\n8.34 Last one\nends"}, "iso27002")
    assert got == [(0, "5", "5", "domain", "active", "Theme 5", None, None), (1, "5.1", "5.1", "control", "active", "Control 5.1", "The text.\n5.1.2 Not a control\n9.1 nor this", "5"), (2, "8.34", "8.34", "control", "active", "Control 8.34", "ends", None)]
    got = read_iso(spark, {1: "CLD.6.3 Relationship\nCLD.6.3.1 Shared roles\nmore\n5 Policies\n5.1 Direction\n5.1.1 Rules\ntext\n18 Compliance\n19 no section\n4.1 nor this"}, "iso27017")
    assert [(c, kind, title, body, parent) for _, c, _, kind, _, title, body, parent in got] == [("5", "control", "Control 5", None, None), ("5.1", "control", "Control 5.1", None, "5"), ("5.1.1", "control", "Control 5.1.1", "text", "5.1"), ("18", "control", "Control 18", "19 no section\n4.1 nor this", None), ("CLD.6.3", "control", "Control CLD.6.3", None, None), ("CLD.6.3.1", "control", "Control CLD.6.3.1", "more", "CLD.6.3")]
    got = read_iso(spark, {1: "A.2.1 Obligation\nwhat it says\n9 Access\n9.2 User access\n9.2.1 Registration\nA.2 Consent"}, "iso27018")
    assert [(c, kind, title, body, parent) for _, c, _, kind, _, title, body, parent in got] == [("9", "control", "Control 9", None, None), ("9.2", "control", "Control 9.2", None, "9"), ("9.2.1", "control", "Control 9.2.1", "A.2 Consent", "9.2"), ("A.2.1", "annex-control", "Annex A control A.2.1", "what it says", None)]


def test_amendment_bodies(spark):
    doc = [("d", 1, "Foreword\n4.1\nAdd the following sentence:\nThe organization shall determine it."), ("d", 2, "more of it\n4.2\nReplace this note\nNOTE New.\n9.9\nnot an instruction"), ("e", 1, "A.5.1\nDelete a word")]
    rows = pages.amendment_tree(spark.createDataFrame(doc, "doc_key string, page int, text string")).collect()
    got = {(r.doc_key, r.citation): (r.ordinal, r.amend_action, r.body) for r in rows}
    assert got == {
        ("d", "4.1"): (0, "add", "Add the following sentence:\nThe organization shall determine it.\nmore of it"),
        ("d", "4.2"): (1, "replace", "Replace this note\nNOTE New.\n9.9\nnot an instruction"), ("e", "A.5.1"): (0, "delete", "Delete a word"),
    }


def test_bodies_without_their_attributes(spark):
    texts = [("Control type\n#Preventive\nx\nControl\nThe text stays.", "The text stays."), ("No table here.\nControl\nrest", "No table here.\nControl\nrest"), ("#tag only", "#tag only"), ("Control\n#late\nControl\n end ", "end"), ("#t\n" + "x\n" * 30 + "Control\nfar", "#t\n" + "x\n" * 30 + "Control\nfar")]
    rows = spark.createDataFrame(texts, "body string, want string").select(iso.strip_attributes(F.col("body")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
