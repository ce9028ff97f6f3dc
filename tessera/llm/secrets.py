"""Secret scans: strong patterns stand alone, weak ones are reported only beside their complement.

A credential has parts: an access identifier, a secret, an endpoint. Strong parts (`assign`, `access`, `hex`) are
reported wherever they are. Weak parts (`id`, `key`, `endpoint`) look like many harmless strings; they are joined
with the other parts of their document by interval: an `id` needs a secret, and a `key` an identifier, whose gap to it
is at most `scope` code points; an `endpoint` needs both. The interval join is a sweep: parts of a document in order
of their start, with the furthest end before and the nearest start after, so that no pair is built.

Defined results: null and empty texts have no spans. Equal rows get equal results, each its own row. A null doc_id is
a value as any other. A weak part that overlaps a strong one is the same string and left out. Text that is no valid
UTF-8 is read with U+FFFD for what cannot be read. An empty table gives no rows. Columns other than doc_id and text are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

#: Kinds in the order in which spans with the same start are listed, with the part that each one is.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "key": "secret", "endpoint": "endpoint"}
STRONG = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 8

WORDS = ("passw", "secret", "token", "apikey", "api_key")
ID_WORDS = ("user", "login", "account", "client", "access")
WEAK_ID = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", re.A)

SCOPE = 200
PARTS = "array<struct<start:bigint,kind:string,end:bigint>>"


def parts_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of strong parts, and of weak ones where the document has their complement at all."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    ids = [(m.start(), "id", m.end()) for m in WEAK_ID.finditer(text)] if any(w in low for w in ID_WORDS) else []
    if ids or any(kind == "access" for _, kind, _ in found):
        keys = [(m.start(), "key", m.end()) for m in WEAK_KEY.finditer(text)]
        if keys or any(kind != "access" for _, kind, _ in found):
            weak = ids + keys + [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
            taken = sorted((s, e) for s, _, e in found)
            found += _clear_of(sorted(weak), taken)
    return sorted(found, key=lambda p: p[0])


def _clear_of(weak: list[tuple[int, str, int]], taken: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    """The weak parts that overlap no taken span; both sorted by their start."""
    out, k, last = [], 0, -1
    for start, kind, end in weak:
        while k < len(taken) and taken[k][0] < end:
            last = max(last, taken[k][1])
            k += 1
        if last <= start:
            out.append((start, kind, end))
    return out


def find_parts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """__key, the columns and __parts of each document. __key stands for doc_id and text, so equal rows share it."""
    docs = docs.withColumn("text", F.make_valid_utf8("text"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text"), F.length("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            parts = [[dict(zip(("start", "kind", "end"), p)) for p in parts_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("__key", *columns)), pa.array(parts, kind)], ["__key", *columns, "__parts"])

    read = docs.select(key.alias("__key"), *dict.fromkeys([*columns, "text"]))
    schema = read.select("__key", *columns).withColumn("__parts", F.lit(None).cast(PARTS)).schema
    return read.mapInArrow(scan, schema)


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with their complement in scope. parts: (key, start, kind, end), of which equal rows count once.

    A window holds the parts of one document, whose number its text bounds.
    """
    parts = parts.distinct()
    role = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("kind"))
    order = Window.partitionBy("key").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = lambda what: F.coalesce(F.max(F.when(F.col("role") == what, F.col("end"))).over(before) >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.min(F.when(F.col("role") == what, F.col("start"))).over(after) <= F.col("end") + scope, F.lit(False))
    held = parts.withColumn("role", role).withColumns({"by_id": near("id"), "by_secret": near("secret")})
    ok = F.when(F.col("kind") == "id", F.col("by_secret")).when(F.col("kind") == "key", F.col("by_id")).when(F.col("kind") == "endpoint", F.col("by_id") & F.col("by_secret")).otherwise(False)
    return held.filter(ok).select("key", "start", "kind", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key, doc_id, base and spans of every document: arrays of (start, kind, end), sorted by start, then kind as in KINDS.

    base has the strong parts, spans these and the linked weak ones. The text is read once; what follows works on the
    parts, a few numbers a document.
    """
    return ordered_spans(durable(find_parts(docs, ["doc_id"]).withColumnsRenamed({"__key": "key", "__parts": "parts"}), "secret-parts"), scope)


def ordered_spans(found: DataFrame, scope: int) -> DataFrame:
    """found, of key and parts, with base and spans in their place."""
    weak = found.filter(F.exists("parts", lambda p: ~p["kind"].isin(*STRONG)))
    linked = link(weak.select("key", F.inline("parts")), scope)
    linked = linked.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    strong = F.filter("parts", lambda p: p["kind"].isin(*STRONG))
    place = lambda p: F.struct(p["start"], F.array_position(F.array(*map(F.lit, KINDS)), p["kind"]), p["end"])
    ordered = lambda parts: F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(place(p).alias("at"), p.alias("part")))), lambda x: x["part"])
    joined = found.join(linked, "key", "left")
    return joined.select(*[c for c in found.columns if c != "parts"], ordered(strong).alias("base"), ordered(F.concat(strong, F.coalesce("linked", F.array().cast(PARTS)))).alias("spans"))


def mask_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced; overlapping spans become one mask. Documents without spans stay as they are."""
    columns = docs.columns
    found = durable(find_parts(docs, columns), "secret-parts")
    some = found.filter(F.size("__parts") > 0)
    linked = ordered_spans(some.select(F.col("__key").alias("key"), F.col("__parts").alias("parts")).dropDuplicates(["key"]), scope)
    hit = some.join(linked.select(F.col("key").alias("__key"), F.transform("spans", lambda p: F.struct(p["start"], p["end"])).alias("__spans")), "__key")

    def masked(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [text[at : s["start"]], mask]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type)).select(columns)

    return found.filter(F.size("__parts") == 0).select(columns).unionAll(hit.select(*columns, "__spans").mapInArrow(run, docs.schema))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, STRONG), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
