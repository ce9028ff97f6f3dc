"""Citations: finding them in a query, cleaning them up, and reading their structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Citation schemes and their patterns, the most specific first.
SCHEMES = {
    "cobit-objective": r"\b([A-Z]{3}\d{2}\.\d{2})\b",
    "csf-workbook": r"\b([A-Z]{2}\.[A-Z]{2}-\d{2})\b",
    "oscal-catalog": r"\b([A-Z]{2}-\d{1,2}(?:\(\d+\))?)(?:\b|$|[^A-Za-z0-9(])",
    "ccm-workbook": r"\b([A-Z][A-Z&]{1,4}-\d{2})\b",
    "tsc-criteria": r"\b((?:CC|A|PI|P|C)\d+\.\d+)\b",
    "pci-requirement": r"\b(?:REQ(?:UIREMENT)?\s+)?(\d{1,2}\.\d+(?:\.\d+)*)\b",
    "iso-ams": r"\b([A-Z]?\.\d+(?:\.\d+)*|\d+\.\d+(?:\.\d+)?)\b",
    "iso-control-catalog": r"\b((?:CLD\.)?\d+(?:\.\d+){1,3})\b",
    "cis-workbook": r"\b(\d{1,2}(?:\.\d{1,2}){1,2})\b",
    "cscf-control": r"\b(\d\.\d+[A-Z]?)\b",
}

#: Forms of an ISO reference; the second names a clause, the others a control of the annex.
ISO_FORMS = ("Annex A Controls:", "Mandatory Clause:", "Control")


def match_citations(query: Column, scheme: str | None = None) -> Column:
    """Distinct (scheme, citation) in order, of one scheme or of all; an unknown scheme matches nothing."""
    schemes = SCHEMES if scheme is None else {k: v for k, v in SCHEMES.items() if k == scheme}
    upper = F.upper(F.coalesce(query, F.lit("")))
    named = lambda scheme: lambda c: F.struct(F.lit(scheme).alias("scheme"), c.alias("citation"))
    found = [F.transform(F.regexp_extract_all(upper, F.lit(p), F.lit(1)), named(s)) for s, p in schemes.items()]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<struct<scheme:string,citation:string>>")


def clean_citation(text: Column) -> Column:
    """Without white space; an enhancement written with a dot gets its brackets: AC-2.3 is AC-2(3)."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"^([A-Za-z]{2}-\d+)\.(\d+)$", r"$1($2)")


def zero_pad(citation: Column) -> Column:
    """Single digits 1 to 9 after a hyphen or alone in brackets get a zero before them."""
    return F.regexp_replace(F.regexp_replace(citation, r"-([1-9])(?![0-9])", "-0$1"), r"\(([1-9])\)", "(0$1)")


def cite_string(citation: Column, framework: Column, version: Column) -> Column:
    """`citation, framework version`; blank parts are left out."""
    some = lambda c: F.when(c != "", c)
    place = F.concat_ws(" ", some(framework), some(version))
    return F.concat_ws(", ", some(citation), some(place))


def version_status(is_current: Column) -> Column:
    return F.when(is_current, "current").otherwise("superseded")


def dotted_parent(citation: Column) -> Column:
    """The citation less its last dotted part; null for a root, as is `CLD.x.y`."""
    root = ~citation.contains(".") | citation.rlike(r"^CLD\.\d+\.\d+$")
    return F.when(~root, F.regexp_replace(citation, r"\.[^.]*$", ""))


def category_parent(citation: Column) -> Column:
    """A subcategory's category: the id up to its last hyphen; null without one."""
    return F.when(citation.contains("-"), F.regexp_replace(citation, r"-[^-]*$", ""))


def dotted_order(citation: Column) -> Column:
    """A key that sorts dotted numbers by value, and a shorter one before those it begins."""
    return F.transform(F.split(citation, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 8, "0")).otherwise(p))


def title_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(title), r"\s+", " "))


def cell_column(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^([A-Z]+)\d+$", 1)


def cell_row(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^[A-Z]+(\d+)$", 1).try_cast("int")


def iso_reference(text: Column) -> Column:
    """The citation in an ISO reference of the 2022 edition; null for another edition or form, for none, and for a list.

    `2022: Annex A Controls: 5.1` and `2022: Control 5.1` name A.5.1, `2022: Mandatory Clause: 4.1` names 4.1. Commas
    at the end are let pass.
    """
    form = rf"^2022:\s*({'|'.join(ISO_FORMS)})(.*)$"
    named = F.trim(F.regexp_extract(text, form, 2))
    cite = F.trim(F.regexp_replace(named, r",+$", ""))
    skip = (cite == "") | (F.lower(named) == "none") | cite.contains(",")
    return F.when(~skip, F.when(F.regexp_extract(text, form, 1) == ISO_FORMS[1], cite).otherwise(F.concat(F.lit("A."), cite)))


def iso_target(text: Column) -> Column:
    """A target in an ISO standard: A5.9 of its annex as A.5.9, a clause's number as it is; null for other shapes."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^A\d+\.\d+$"), F.regexp_replace(bare, "^A", "A.")).when(bare.rlike(r"^\d+(?:\.\d+)*$"), bare)


def csf_target(text: Column) -> Column:
    bare = F.upper(F.trim(text))
    return F.when(bare.rlike(r"^[A-Z]{2}\.[A-Z]{2}-\d{2}$"), bare)


def sp80053_target(text: Column) -> Column:
    """A control or enhancement with two digits in each number: AC-2(3) is AC-02(03)."""
    bare = F.upper(F.trim(text))
    padded = F.regexp_replace(F.regexp_replace(bare, r"-(\d)($|\()", "-0$1$2"), r"\((\d)\)", "(0$1)")
    return F.when(bare.rlike(r"^[A-Z]{2}-\d+(?:\(\d+\))?$"), padded)
