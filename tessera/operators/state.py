"""State of the ingest: each operator maps whole state tables to the next ones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("extracted_at", "normalized_at", "indexed_at")


_ITEM = r"(?:\\.|[^\\\]-])"
_GLOB = re.compile(rf"(?P<any>\*)|(?P<one>\?)|\[(?P<not>\^?)(?P<items>(?:{_ITEM}(?:-{_ITEM})?)+)\]|\\(?P<quoted>.)|(?P<plain>[^\[\\])", re.S)


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression over a whole path; null for a bad one, which fits nothing.

    * stands for any characters of one part of the path and ? for one of them; two stars say no more than one. A class
    such as [a-f_] or [^0-9] may hold a slash too; a backslash takes away a character's meaning.
    """
    literal = lambda c: c if c.isalnum() or ord(c) > 127 else "\\" + c
    out, at = ["(?s)^"], 0
    while at < len(pattern):
        m = _GLOB.match(pattern, at)
        if not m:
            return None
        if m["items"]:
            ends = [[literal(x[-1]) for x in pair if x] for pair in re.findall(rf"({_ITEM})(?:-({_ITEM}))?", m["items"], re.S)]
            ends = [e for e in ends if len(e) == 1 or e[0][-1] <= e[1][-1]]  # a range that ends before it begins holds nothing
            out.append(f"[{m['not']}{''.join('-'.join(e) for e in ends)}]" if ends else "." if m["not"] else "(?!)")
        else:
            out.append("[^/]*" if m["any"] else "[^/]" if m["one"] else literal(m["quoted"] or m["plain"]))
        at = m.end()
    return "".join([*out, r"\z"])


def match_rules(files: DataFrame, rules: Sequence[dict], key: str = "rel_path") -> DataFrame:
    """files with the fields of the first rule whose pattern, a glob, fits; nulls where none does. rules: dicts of equal keys, pattern among them, in order."""
    fields = [c for c in rules[0] if c != "pattern"] if rules else []
    found = None
    for rule in rules:
        if (regex := glob_regex(rule["pattern"])) is not None:
            fits, value = F.col(key).rlike(regex), F.struct(*[F.lit(rule[c]).alias(c) for c in fields])
            found = F.when(fits, value) if found is None else found.when(fits, value)
    if found is None:
        return files.withColumns({c: F.lit(None) for c in fields})
    return files.withColumn("__rule", found).select(*files.columns, *[F.col(f"__rule.{c}") for c in fields])


def upsert_manifest(old: DataFrame, scan: DataFrame, key: str = "rel_path", digest: str = "sha256", stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The next manifest: scanned files, whose stages stay if their digest does; files that are gone become `removed`, unless the scan is empty."""
    o, n = old.alias("o"), scan.alias("n")
    held = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    seen = F.col(f"n.{key}").isNotNull()
    same = F.col(f"o.{digest}") == F.col(f"n.{digest}")
    any_seen = scan.limit(1).agg(F.count("*").alias("any"))  # one row
    held = held.crossJoin(F.broadcast(any_seen))
    keep = ~seen | F.coalesce(same, F.lit(False))
    status = F.when(seen, "active").when((F.col("any") == 1) & (F.col("o.status") == "active"), "removed").otherwise(F.col("o.status"))
    return held.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), F.coalesce(f"n.{digest}", f"o.{digest}").alias(digest), status.alias("status"), *[F.when(keep, F.col(f"o.{s}")).alias(s) for s in stages])


def mark(manifest: DataFrame, done: DataFrame, stage: str, at: Column, key: str = "rel_path") -> DataFrame:
    """The manifest with a stage done for some files, and its error cleared; later stages are due again."""
    later = STAGES[STAGES.index(stage) + 1 :]
    held = manifest.join(done.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    hit = F.coalesce("__done", F.lit(False))
    changed = {stage: F.when(hit, at).otherwise(F.col(stage))} | {s: F.when(~hit, F.col(s)) for s in later}
    if "stage_error" in manifest.columns:
        changed["stage_error"] = F.when(~hit, F.col("stage_error"))
    return held.withColumns(changed).select(manifest.columns)


def eligible(manifest: DataFrame, stage: str) -> DataFrame:
    """Files that a stage is due for: active, recognised, not ambiguous, the stage before done and this one not. A null role is not eligible."""
    k = STAGES.index(stage)
    due = (F.col("status") == "active") & ~F.col("ignored") & F.col("framework_code").isNotNull() & ~F.col("doc_role").isin("guide", "changelog") & F.col(stage).isNull()
    if k:
        due = due & F.col(STAGES[k - 1]).isNotNull()
    return manifest.filter(due)


def ambiguous(files: DataFrame, keys: list[str], name: str = "is_ambiguous") -> DataFrame:
    """files with a flag: another file has the same identity. Counts meet rows in a join, so that a frequent identity may be split."""
    n = files.groupBy(*keys).agg(F.count("*").alias("__n"))
    held = files.alias("x").join(n.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    return held.select("x.*", (F.col("__n") > 1).alias(name))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(chunks: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks to keep, and those whose control is gone."""
    ids = controls.select(F.col("id").alias("control_id"))
    return chunks.join(ids, "control_id", "left_semi"), chunks.join(ids, "control_id", "left_anti")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without an embedding by this very model; dimensions do not matter."""
    have = embeddings.filter(F.col("model") == model).select(F.col("chunk_id").alias("id"))
    return chunks.join(have, "id", "left_anti")


def overlay(seed: DataFrame, user: DataFrame, keys: list[str]) -> DataFrame:
    """A registry after seeding: the user's rows, and seed rows of other keys."""
    return user.withColumn("origin", F.lit("user")).unionByName(seed.join(user.select(*keys), keys, "left_anti").withColumn("origin", F.lit("seed")))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row for each key: what upserts leave."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str], replaced: Sequence[str] = (), coalesced: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """old after the rows of new, by keys of which nulls are equal, in one join. Columns are those of old.

    A key that is there keeps its row: `replaced` columns take the new value, `coalesced` ones take it unless it is null,
    and all others stay, whatever new says of them. A key that is not there gets the new row; columns that new lacks are
    null. Of new rows with equal keys, which `order` tells apart, each is applied to what the ones before it left.
    """
    rest = [c for c in old.columns if c not in keys]
    own = [c for c in rest if c in new.columns]
    bad = (set(replaced) | set(coalesced)) - set(own)
    if bad:
        raise ValueError(f"no such columns to merge: {sorted(bad)}")
    first = [c for c in own if c not in replaced and c not in coalesced]
    if order:
        at = F.col(order)
        found = new.groupBy(*keys).agg(
            F.max_by(F.struct(*replaced, F.lit(1).alias("__")), at).alias("__last"), F.min_by(F.struct(*first, F.lit(1).alias("__")), at).alias("__first"),
            *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in coalesced])
        value = {c: F.col(f"n.__last.{c}") for c in replaced} | {c: F.col(f"n.__first.{c}") for c in first} | {c: F.col(f"n.__{c}") for c in coalesced}
    else:
        found, value = new, {c: F.col(f"n.{c}") for c in own}
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), found.withColumn("__new", F.lit(True)).alias("n")
    held = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    was, now = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    none = F.lit(None)

    def column(c: str) -> Column:
        if c in keys:
            return F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in replaced:
            return F.when(now, value[c]).otherwise(F.col(f"o.{c}"))
        if c in coalesced:
            return F.coalesce(value[c], F.col(f"o.{c}"))
        return F.when(was, F.col(f"o.{c}")).otherwise(value.get(c, none))

    return held.select(*[column(c).alias(c) for c in old.columns])
