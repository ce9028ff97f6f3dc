"""Line dedup by winnowing: later repeats of runs of lines are deleted.

A line's hash, of 124 bits, is taken from its text without outer white space and stands for it, as does a run's of 128
for its lines: no text is compared. Lines without a word do not count.

1. Windows. From each line on, the run ahead holds the fewest lines that reach `least` words, and the run behind holds the
   fewest that reach them up to this line. What a window holds depends on its lines alone.
2. Fingerprints. A window selects the first of its lines with the least hash. Equal windows select the same line, so
   whatever stretch of at least `least` words also stands earlier, in another document or in its own, has a fingerprint
   in each of its windows that stands in both places.
3. Positions. Fingerprints are joined by hash: one with a single position matches nothing, and the windows that it stands
   for, which are most, end here.
4. Extension. From the others matches extend both ways, by the windows ahead and behind of each line around them: a
   window is keyed by all its lines, and the first place of each key decides, so that no pair of places is compared and
   a fingerprint of many contexts has one row for each distinct one. Windows with an earlier place are deleted; those of
   one match lap, and together they are all of it.

A line is only ever deleted for an equal one at an earlier place, so the first of all stays.

Everything is DataFrame operations. A key's first place comes from partial minima; the join that follows meets a
frequent run once a document and may split it. Windows hold the lines of one document, frames `least` lines at most.

Defined results: a null text has no lines and stays null; an empty one stays empty. A document that is deleted whole
is an empty text. Order is that of doc_id, nulls last, then of a hash of the text. Equal rows are one document here:
each of them gets the same result. An empty table gives no rows. All columns of the input stay as they are but text, and the
one that takes the number of deleted lines, n_removed by default, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, table, words

#: Words that a repeated run has at least.
LEAST = 50
_KEY = ["doc", "place"]
_BLANK = " \t\n\r\x0b\f"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, place, lines: of each document the lines that have a word, as (raw: number in the text, hash, words)."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    digest = lambda x: F.struct(F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long"), F.xxhash64(x))
    line = lambda x, i: F.struct(i.alias("raw"), digest(_trimmed(x)).alias("hash"), F.size(words(x)).alias("words"))
    found = F.filter(F.transform(split, line), lambda x: x["words"] > 0)
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("place"), found.alias("lines"))


def runs_of(lines: DataFrame, least: int) -> DataFrame:
    """doc, place, start, end, key, check, low, at: the windows, of at least `least` words, from each line on and up to it; key and check are hashes of all their lines, low is the fingerprint, and at its position's hash."""
    each = lines.dropDuplicates(_KEY).select(*_KEY, F.posexplode("lines").alias("pos", "line")).select(*_KEY, "pos", "line.hash", "line.words")
    each = each.withColumn("ends", F.sum("words").over(Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    each = each.withColumn("begins", F.col("ends") - F.col("words"))
    frames = {"ahead": Window.partitionBy(*_KEY).orderBy("begins").rangeBetween(0, least - 1), "behind": Window.partitionBy(*_KEY).orderBy("ends").rangeBetween(1 - least, 0)}
    for way, frame in frames.items():
        each = each.withColumns({way: F.collect_list("hash").over(frame), f"{way}_words": F.sum("words").over(frame)})
    hashes = lambda way: (F.xxhash64(F.lit(way), way).alias("key"), F.xxhash64(F.lit(f"{way} again"), way).alias("check"))
    low = lambda way, start: (F.array_min(way).alias("low"), F.xxhash64(*_KEY, start + F.array_position(way, F.array_min(way))).alias("at"))
    run = lambda way, start, end: F.when(F.col(f"{way}_words") >= least, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), *hashes(way), *low(way, start)))
    ahead = run("ahead", F.col("pos"), F.col("pos") + F.size("ahead") - 1)
    behind = run("behind", F.col("pos") - F.size("behind") + 1, F.col("pos"))
    return each.select(*_KEY, F.inline(F.array_compact(F.array(ahead, behind))))


def matching(runs: DataFrame) -> DataFrame:
    """The windows whose fingerprint stands at two positions or more."""
    joined = runs.groupBy("low").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last")
    return runs.join(joined, "low", "left_semi")


def later_runs(runs: DataFrame) -> DataFrame:
    """doc, place, start, end: the runs that also stand at an earlier place."""
    runs = runs.select(*_KEY, "start", "end", "key", "check")
    first = runs.groupBy("key", "check").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "place", "start")).alias("at"), F.count("*").alias("n")).filter("n > 1")
    own = F.col("doc").eqNullSafe(F.col("at.doc")) & (F.col("place") == F.col("at.place")) & (F.col("start") == F.col("at.start"))
    return runs.join(first, ["key", "check"]).filter(~own).select(*_KEY, "start", "end")


def repeated_runs(lines: DataFrame, least: int) -> DataFrame:
    """doc, place, removed: first and last numbers of stretches whose lines are of later repeated runs, for documents that have any."""
    runs = durable(runs_of(lines, least), "runs")
    later = later_runs(durable(matching(runs).drop("low", "at"), "matches"))
    order = Window.partitionBy(*_KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("apart", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))  # from all runs before, neither lapping nor touching
    pieces = apart.withColumn("stretch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.groupBy(*_KEY, "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    pieces = pieces.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("pieces"))
    same = lambda a: (F.col(f"x.{a}").eqNullSafe(F.col(f"y.{a}")))
    held = pieces.alias("x").join(lines.dropDuplicates(_KEY).alias("y"), same("doc") & same("place")).select("x.*", "y.lines")
    raw = lambda k: F.element_at("lines", k + 1)["raw"]
    numbers = F.transform("pieces", lambda p: F.struct(raw(p["start"]).alias("first"), raw(p["end"]).alias("last"), (p["end"] - p["start"] + 1).alias("n")))
    return held.select(*_KEY, numbers.alias("removed"))


def dedup_lines(docs: DataFrame, least: int = LEAST, counted: str | None = "n_removed") -> DataFrame:
    """docs with later repeated runs of lines deleted from text, and, as the column `counted` names unless it is none, the number of those lines."""
    lines = durable(lines_of(docs), "lines")
    runs = repeated_runs(lines, least).select(F.col("doc").alias("__doc"), F.col("place").alias("__place"), F.col("removed").alias("__removed"))
    keyed = docs.withColumn("__at", F.xxhash64("text"))
    held = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__at") == F.col("__place")), "left")
    within = lambda i: F.exists("__removed", lambda p: i.between(p["first"], p["last"]))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~(within(i) & (_trimmed(x) != ""))), "\n")
    return held.select(*[F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns if c != counted], *([F.coalesce(F.aggregate("__removed", F.lit(0), lambda n, p: n + p["n"]), F.lit(0)).alias(counted)] if counted else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), "text")


_SQL = rf"""
with raw as materialized (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as raw from documents),
    counted as (select *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words from raw),
    lines as materialized (select doc_id, raw, words, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as line, row_number() over (partition by doc_id order by raw) - 1 as pos from counted where words > 0),
    equals as (select a.doc_id, b.doc_id as doc0, a.pos - b.pos as shift, a.pos, a.raw, a.words, a.pos - row_number() over (partition by a.doc_id, b.doc_id, a.pos - b.pos order by a.pos) as run
        from lines a join lines b on a.line = b.line and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.pos < a.pos))),
    runs as (select doc_id, raw, sum(words) over (partition by doc_id, doc0, shift, run) as total from equals),
    removed as (select distinct doc_id, raw from runs where total >= {LEAST}),
    kept as (select r.doc_id, string_agg(r.line, chr(10) order by r.raw) filter (x.raw is null) as text, count(x.raw) as n_removed from raw r left join removed x on x.doc_id = r.doc_id and x.raw = r.raw group by 1)
select d.doc_id, k.n_removed::bigint as n_removed, case when d.text is null then null else coalesce(k.text, '') end as text from documents d join kept k using (doc_id)"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": _SQL}
