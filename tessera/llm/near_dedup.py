"""MinHash near-dedup with HyperMinHash registers, verified on full shingle sets.

1. A document's set of word shingles is hashed; documents with equal sets are one class, named by the set's digest.
2. A class's signature: hashes fall into 128 buckets by their first bits; a bucket keeps of its least hash the number
   of leading zeros (6 bits) and the bits after them (10 bits). An empty bucket copies another by a fixed order.
3. Bands of 4 registers bring classes together. Two classes at the threshold of 0.8 share none of the 32 bands with
   a probability of 5e-8.
4. In each band's bucket all classes are paired with its first and last class only. Pairs whose estimate, corrected
   for registers that agree by chance, comes near the threshold are likely; likely ones make clusters. Likely pairs
   are confirmed on their full sets, and linked ones make components within the clusters.
5. What is left to compare are classes of different components. Within a cluster, those outside its largest component
   are compared with all others there, in blocks of bounded size; a block holds registers first, sets of those members
   only that have a likely partner in it, and returns links only. Across clusters, a large band's bucket is compared in
   blocks likewise; in others the estimate is a condition of their join, and pairs are confirmed as in step 4. So no
   link between different texts is lost, and a group of near copies, however large, never forms all its pairs.

Components come from alternating star contractions, each written before the next. Classes, links and labels are
always distributed tables.

Defined results: a null or empty text, or one without words, has no set, is linked with nothing and kept. Equal rows
are in one class. Rows without a doc_id take part; their component's id is the least id there, null if none has one.
Very long texts have large sets, held one document at a time. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

SHINGLE, SIMILARITY = 5, 80  # words, and hundredths: what operators use unless told otherwise
REGISTERS, ROWS = 128, 4
BUCKET_BITS, MANTISSA_BITS = 7, 10
#: Chance that a register of unrelated sets agrees: 0.1699 * 2 ** -10 by the analysis of HyperMinHash; then that of one folded to 7 bits.
BY_CHANCE, BY_CHANCE_FOLDED = 0.1699 * 2.0**-MANTISSA_BITS, 2.0**-7
#: Longs of a sketch, with a folded register in each of the lower seven bytes.
SKETCH = -(-REGISTERS // 7)
#: Estimates are confirmed from the threshold less five standard errors.
MARGIN = 5.0
#: Classes in a block, about.
BLOCK = 256

_ORDER = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


class _Hashes(dict):
    """Hash of a word. Emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int, known: _Hashes) -> np.ndarray:
    """Hashes of the distinct shingles of `size` words, ascending; of the whole sequence if it has fewer words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1) if len(h) else 0
    x = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(1))
    return np.unique(x)


def registers(s: np.ndarray) -> np.ndarray:
    """The signature of a set that is not empty."""
    first = np.searchsorted(s, _EDGES)
    full = np.append(first[1:], len(s)) > first
    least = s[np.minimum(first, len(s) - 1)] << np.uint64(BUCKET_BITS)
    if not full.all():
        least = least[np.where(full, np.arange(REGISTERS), _ORDER[np.arange(REGISTERS), full[_ORDER].argmax(1)])]
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    bits = ((2 * mantissa - 1).clip(0) * (1 << MANTISSA_BITS)).astype(np.uint16)
    return (zeros.astype(np.uint16) << MANTISSA_BITS) | bits


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, place (a hash of the text), n_shingles, node (the set's digest, null for an empty one), registers (null likewise)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size, known)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s) else (0, None, None))
            n, node, regs = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), batch.column("place"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "place", "n_shingles", "node", "registers"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("place"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(scan, f"doc_id {doc_type}, place bigint, n_shingles bigint, node binary, registers binary")


def bands(nodes: DataFrame) -> DataFrame:
    """band, node: a row for each band of each class. A band is the hash of its number and registers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = REGISTERS // ROWS
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(-1, n)
                keys = _mix(_mix(regs) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))], ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(cut, "band bigint, node binary")


def sketches(nodes: DataFrame) -> DataFrame:
    """node, n_shingles and the registers folded to 7 bits, seven to each of s0, s1, ..."""
    names = [f"s{k}" for k in range(SKETCH)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).astype(np.uint64)
                lanes = np.zeros((batch.num_rows, 7 * SKETCH), np.uint8)
                lanes[:, :REGISTERS] = (_mix(regs) >> np.uint64(57)).reshape(batch.num_rows, -1)
                longs = np.zeros((batch.num_rows, SKETCH, 8), np.uint8)
                longs[:, :, :7] = lanes.reshape(batch.num_rows, SKETCH, 7)
                longs = longs.reshape(batch.num_rows, -1).view(np.int64)
                yield pa.record_batch([batch.column("node"), batch.column("n_shingles"), *(pa.array(longs[:, k]) for k in range(SKETCH))], ["node", "n_shingles", *names])

    return nodes.select("node", "n_shingles", "registers").mapInArrow(fold, "node binary, n_shingles bigint, " + ", ".join(f"{s} bigint" for s in names))


def likely(a: str, b: str, similarity: int) -> Column:
    """Whether the classes of aliases a and b, as sketches() has them, may be similar enough: sizes fit, and the estimate is near.

    Adding 0x7F to a byte sets its highest bit unless the byte is 0, that is, unless two registers agree.
    """
    differ = " + ".join(f"bit_count((({a}.s{k} ^ {b}.s{k}) + {0x7F7F7F7F7F7F7F}) & {0x80808080808080})" for k in range(SKETCH))
    least = similarity / 100
    least -= MARGIN * (least * (1 - least) / REGISTERS) ** 0.5
    agree = least + (1 - least) * (BY_CHANCE + BY_CHANCE_FOLDED)
    sizes = f"100 * least({a}.n_shingles, {b}.n_shingles) >= {similarity} * greatest({a}.n_shingles, {b}.n_shingles)"
    return F.expr(f"{sizes} and {differ} <= {int(REGISTERS * (1 - agree))}")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. texts: node, text."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, held = _Hashes(), None, None
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                ta = ta.as_py()
                if ta != last:
                    last, held = ta, shingle_set(ta, size, known)
                other = shingle_set(tb.as_py(), size, known)
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(100 * both >= similarity * (len(held) + len(other) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    held = held.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return held.select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge (a, b): the least node of its component. Alternating large and small stars."""
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        edges = durable(small, "edges")


def deal_blocks(members: DataFrame, block: int) -> DataFrame:
    """members (node, cluster, root and more), each in all the blocks that it is compared in: with cluster, i, j, vs, is_major.

    Members of a cluster's largest component are its major ones and not compared with each other. Minor and major
    ones are dealt to blocks by hash; each pair of a minor block with any block is one group.
    """
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.select("cluster", "major", blocks(F.col("n_major")).alias("majors"), blocks(F.col("n") - F.col("n_major")).alias("minors"))
    held = members.join(sizes, "cluster").withColumn("is_major", F.col("root") == F.col("major"))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    held = held.withColumn("own", own)
    others = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"), F.lit(False).alias("vs")))
    against = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("vs")))
    by_minor = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(True).alias("vs")))
    dealt = held.withColumn("to", F.explode(F.when(F.col("is_major"), by_minor).otherwise(F.concat(others, against))))
    return dealt.select(*members.columns, "is_major", "to.*")


def near_in_block(regs: np.ndarray, lens: np.ndarray, own: np.ndarray, major: np.ndarray, vs: bool, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each member the later ones, or the major ones, of other components that are likely to be similar enough. own is read anew for each."""
    near = similarity / 100
    near -= MARGIN * (near * (1 - near) / REGISTERS) ** 0.5
    for x in range(len(lens)):
        if vs and major[x]:
            continue
        y = major if vs else np.arange(len(lens)) > x
        y = np.nonzero(y & (own != own[x]) & (100 * np.minimum(lens, lens[x]) >= similarity * np.maximum(lens, lens[x])))[0]
        if len(y):
            yield x, y[(regs[y] == regs[x]).mean(1) >= near]


def compare_blocks(members: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: int, block: int | None = None) -> DataFrame:
    """Links (a, b) between members of one cluster and different components. members: node, cluster, root; nodes: node, n_shingles, registers.

    Blocks first hold registers; texts follow only for the members of a block that have a likely partner there.
    """
    group = ["cluster", "i", "j", "vs"]
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    dealt = deal_blocks(members.join(nodes.select("node", "n_shingles", "registers"), "node"), block or BLOCK)

    def arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        roots = rows.column("root").to_pylist()
        numbers = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        return np.array([numbers[r] for r in roots]), np.array(rows.column("is_major").to_pylist(), bool)

    def pick(key: tuple, rows: pa.Table) -> pa.Table:
        own, major = arrays(rows)
        regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        some = np.zeros(len(own), bool)
        for x, y in near_in_block(regs, rows.column("n_shingles").to_numpy(), own, major, key[3].as_py(), similarity):
            some[y] = True
            some[x] |= len(y) > 0
        return rows.filter(pa.array(some)).select([*group, "node", "root", "is_major"])

    likely_ones = dealt.groupBy(*group).applyInArrow(pick, f"cluster {kinds['cluster']}, i int, j int, vs boolean, node binary, root binary, is_major boolean")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        known, nodes = _Hashes(), rows.column("node").to_pylist()
        own, major = arrays(rows)
        sets = [shingle_set(t.as_py(), size, known) for t in rows.column("text")]
        regs, lens = np.stack([registers(s) for s in sets]), np.array([len(s) for s in sets])
        out = []
        for x, y in near_in_block(regs, lens, own, major, key[3].as_py(), similarity):
            for k in y.tolist():
                if own[k] != own[x]:
                    both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                    if 100 * both >= similarity * (lens[x] + lens[k] - both):
                        out.append((nodes[x], nodes[k]))
                        own[own == own[k]] = own[x]
        return pa.table([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], ["a", "b"])

    return likely_ones.join(texts, "node").groupBy(*group).applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, place, n_shingles, node, component (least node; null for an empty set) of every row of docs."""
    sig = durable(signatures(docs, size), "signatures")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    nodes = sig.filter("node is not null").groupBy("node").agg(F.min(F.struct(key.alias("doc"), "place")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = durable(nodes, "classes")

    banded = bands(nodes)
    ends = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).filter("n > 1").drop("n")
    shared = durable(banded.join(ends, "band"), "shared-bands")

    involved = shared.select("node").distinct()
    sketch = durable(sketches(nodes.join(involved, "node", "left_semi")), "sketches")
    places = nodes.join(involved, "node", "left_semi").select("node", "at.doc", "at.place")
    texts = docs.select(key.alias("doc"), F.xxhash64("text").alias("place"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = durable(texts.join(places, ["doc", "place"]).select("node", "text").dropDuplicates(["node"]), "texts")

    star = shared.select("node", F.explode(F.array("first", "last")).alias("hub")).filter("node <> hub")
    star = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    star = star.join(sketch.select(F.col("node").alias("a"), F.struct(*sketch.columns[1:]).alias("x")), "a").join(sketch.select(F.col("node").alias("b"), F.struct(*sketch.columns[1:]).alias("y")), "b")
    star = durable(star.filter(likely("x", "y", similarity)).select("a", "b"), "likely")
    linked = durable(confirm(star, texts, size, similarity), "links")
    roots, clusters = components(linked), components(star).withColumnRenamed("root", "cluster")

    here = shared.select("band", "node").join(roots, "node", "left").join(clusters, "node", "left")
    here = durable(here.select("band", "node", F.coalesce("root", "node").alias("root"), F.coalesce("cluster", "node").alias("cluster")), "band-roots")
    within = compare_blocks(here.select("node", "cluster", "root").distinct(), nodes, texts, size, similarity)

    most = here.groupBy("band", "cluster").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("most"), F.count("*").alias("clusters"), F.sum("n").alias("held")).filter("clusters > 1").drop("clusters")
    large = here.join(most.filter(F.col("held") > BLOCK).select("band"), "band").select("node", F.col("band").alias("cluster"), F.col("cluster").alias("root"))
    across = compare_blocks(large, nodes, texts, size, similarity)
    open_bands = here.join(most.filter(F.col("held") <= BLOCK).drop("held"), "band").join(sketch, "node")
    minor, every = open_bands.filter("cluster <> most").alias("x"), open_bands.alias("y")
    apart = (F.col("x.cluster") != F.col("y.cluster")) & ((F.col("y.cluster") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
    rest = minor.join(every, (F.col("x.band") == F.col("y.band")) & apart & likely("x", "y", similarity))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = durable(within.unionAll(across).unionAll(confirm(rest, texts, size, similarity)), "more-links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    labelled = sig.drop("registers").join(roots, "node", "left")
    return labelled.select("doc_id", "place", "n_shingles", "node", F.coalesce("root", "node").alias("component"))


def with_component_ids(found: DataFrame) -> DataFrame:
    """near_duplicates() with component_id, the least doc_id of the component; an empty set's own."""
    least = found.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))).drop("least")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each group, as it is: that with the least doc_id, one of equal rows. Rows with empty sets stay."""
    found = durable(near_duplicates(docs, size, similarity), "near-duplicates")
    grouped = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("at"))
    kept = grouped.select(F.coalesce(F.col("at.doc_id").cast("string"), F.lit("-")).alias("__doc"), F.col("at.place").alias("__place"))
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "__place": F.xxhash64("text")})
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = keyed.filter(some).join(kept, ["__doc", "__place"], "left_semi").dropDuplicates(["__doc", "__place"])
    return one.unionByName(keyed.filter(~some)).select(docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_component_ids(near_duplicates(table(spark, sf_dir, "documents"), size=2, similarity=80))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES: dict[str, str] = {}
