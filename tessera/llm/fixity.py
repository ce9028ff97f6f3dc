"""WARC: a Merkle audit of the fixity of a replica.

Records are ordered by id. A record's digest is the SHA-256 of its bytes; a node covers a range of ids and so an
offset range of the archive, and its digest is that of its children's, at most 64, in order, with their ids and
lengths. A leaf's number is its id, and a node's is what is left of its leaves' when six bits a level are shifted out,
so that ids may be any longs; the root joins what is left of negative and other ids. Each level is one grouping with a
sixty-fourth of the rows below at best. An audit compares the roots and goes down only where digests differ, level by
level, so that it reads as many nodes as branches are damaged.

Defined results: null columns count as empty. Rows without an id are one leaf, the first, with a null id; so are equal
ids, whose leaf holds the count and sums of its records' digests, in any order. An archive without records has no nodes: all of the
other's records are missing or extra. Columns that are not named do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import durable, table

BITS = 6  # of a node's number that a level takes: 64 children


def record_bytes(url: Column, body: Column) -> Column:
    """A response record as it lies in the archive, without headers that vary between harvests."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """node, length in bytes, digest; one row per id, and one with a null node of rows without an id."""
    record = record_bytes(F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("node"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    part = lambda k: F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    several = F.sha2(F.concat_ws("|", F.count("*"), *(part(k) for k in range(4))), 256)
    return rows.groupBy("node").agg(F.sum("length").alias("length"), F.when(F.count("*") == 1, F.min("digest")).otherwise(several).alias("digest"))


def up(last: bool) -> Column:
    """The node above: the root, 0, if it is the last."""
    return F.lit(0).cast("long") if last else F.shiftright("node", BITS)


def beside(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """A join on a column that may be null, as a node is; it stands once in the result."""
    both = left.join(right.withColumnRenamed(column, "__right"), F.col(column).eqNullSafe(F.col("__right")), how)
    return both.drop("__right") if how in ("inner", "left") else both.withColumn(column, F.coalesce(column, "__right")).drop("__right")


def tree(pages: DataFrame, levels: int) -> list[DataFrame]:
    """node, length, digest of each level: leaves first, the root, node 0, last. Each level is written before the next."""
    found = [durable(leaves(pages), "fixity-0")]
    for level in range(1, levels + 1):
        child = F.struct("node", F.concat_ws(":", F.coalesce(F.col("node").cast("string"), F.lit("-")), "length", "digest").alias("text"))
        digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), "|"), 256)  # of 64 children at most
        above = found[-1].groupBy(up(level == levels).alias("node")).agg(F.sum("length").alias("length"), digest.alias("digest"))
        found.append(durable(above, f"fixity-{level}"))
    return found


def height(*archives: DataFrame) -> int:
    """Levels above the leaves: until what is left of the ids is one number, or one of the negative and one of the others; then the root."""
    ends = [a.agg(F.min("page_id"), F.max("page_id")).first() for a in archives]
    low = min((e[0] for e in ends if e[0] is not None), default=0)
    high = max((e[1] for e in ends if e[1] is not None), default=0)
    levels = 1
    while not (low == high or (low, high) == (-1, 0)):
        low, high, levels = low >> BITS, high >> BITS, levels + 1
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """node, digest, replica_digest of the leaves that differ, found from the roots down. Both are trees of as many levels."""
    bad = None
    for level, (ours, theirs) in enumerate(zip(primary[::-1], replica[::-1], strict=True)):
        if bad is not None:
            within = bad.select(F.col("node").alias("__up"))
            ours, theirs = (t.join(within, up(level == 1).eqNullSafe(F.col("__up")), "left_semi") for t in (ours, theirs))
        both = beside(ours.select("node", "digest"), theirs.select("node", F.col("digest").alias("replica_digest")), "node", "full")
        bad = durable(both.filter(~F.col("digest").eqNullSafe(F.col("replica_digest"))), "fixity-bad")
    return bad


def offsets(levels: list[DataFrame]) -> DataFrame:
    """node, offset, length, digest of the leaves. Offsets come down from the root: a node's is its parent's and its elder siblings' lengths."""
    above = levels[-1].select(F.col("node").alias("up"), F.lit(0).cast("long").alias("base"))
    elder = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows at most
    for k, level in enumerate(levels[-2::-1]):
        nodes = beside(level.withColumn("up", up(k == 0)), above, "up").withColumn("offset", F.col("base") + F.coalesce(F.sum("length").over(elder), F.lit(0)))
        above = nodes.select(F.col("node").alias("up"), F.col("offset").alias("base"))
    return nodes.select("node", "offset", "length", "digest")


def verify(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, offset, length, digest, replica_digest, status of every record of either archive.

    status: ok, changed, missing (from the replica), extra (in the replica only; offset and length are null).
    """
    levels = height(primary, replica)
    ours, theirs = tree(primary, levels), tree(replica, levels)
    bad = audit(ours, theirs).select("node", "replica_digest", F.col("digest").isNull().alias("extra"))
    placed = beside(offsets(ours), bad.withColumn("bad", F.lit(True)), "node", "full")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("extra"), "extra").when(F.col("replica_digest").isNull(), "missing").otherwise("changed")
    return placed.select(F.col("node").alias("page_id"), "offset", "length", "digest", F.when(status == "ok", F.col("digest")).otherwise(F.col("replica_digest")).alias("replica_digest"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with faults at known places, since the tables hold none: bodies cut short, records lost, records too many."""
    fault = F.pmod(F.pmod("page_id", F.lit(997)) * 7919 + 13, F.lit(997))
    kept = pages.filter(F.coalesce(fault != 1, F.lit(True)))
    changed = kept.select("page_id", "url", F.when(fault == 0, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html")).alias("html"))
    return changed.unionAll(pages.filter(fault == 2).select((F.lit(-1) - F.col("page_id")).alias("page_id"), "url", "html"))


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return verify(pages, damaged(pages))


_SQL = r"""
with records as (select page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, ''))::varchar, chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as record,
        concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', strlen(left(html, length(html) - 1))::varchar, chr(13), chr(10), chr(13), chr(10), left(html, length(html) - 1), chr(13), chr(10), chr(13), chr(10)) as shortened,
        (page_id * 7919 + 13) % 997 as fault from pages),
    placed as (select page_id, coalesce(sum(strlen(record)) over (order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", strlen(record)::bigint as length, sha256(record) as digest,
        case fault when 0 then sha256(shortened) when 1 then null else sha256(record) end as replica_digest, case fault when 0 then 'changed' when 1 then 'missing' else 'ok' end as status from records)
select * from placed
union all select -1 - page_id, null, null, null, sha256(record), 'extra' from records where fault = 2"""

QUERIES = {"op9_fixity": op9_fixity}
ORACLES = {"op9_fixity": _SQL}
