"""Retrieval quality: metrics of each case, over all cases, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below these a metric fails.
FLOORS = {"recall": 0.66, "mrr": 0.44, "current": 0.98, "abstain": 0.90}
KEYS = ("framework_code", "version_label", "citation_norm")


def case_metrics(cases: DataFrame, expected: DataFrame, hits: DataFrame) -> DataFrame:
    """found, want, reciprocal_rank, ok, returned, abstain_ok of each case.

    cases: case_id, expect_abstain, expect_fail. expected: case_id and KEYS, a repeated one counting each time. hits:
    case_id, rank, KEYS, is_current. A case without hits abstained. A version that a case names is as good as a
    current one; trailing hits that are neither do not count, unless all are.
    """
    low = [F.lower(k).alias(k) for k in KEYS]
    want = expected.select("case_id", *low)
    hit = hits.select("case_id", "rank", "is_current", *low)
    best = hit.groupBy("case_id", *KEYS).agg(F.min("rank").alias("rank"))
    recall = want.join(best, ["case_id", *KEYS], "left").groupBy("case_id").agg(F.count("*").alias("want"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    pinned = want.select("case_id", "framework_code", "version_label").distinct().withColumn("pinned", F.lit(True))
    good = hit.join(pinned, ["case_id", "framework_code", "version_label"], "left").withColumn("good", F.col("is_current") | F.coalesce("pinned", F.lit(False)))
    last = good.groupBy("case_id").agg(F.max(F.when(F.col("good"), F.col("rank"))).alias("last"))
    current = good.join(last, "case_id").filter(F.col("last").isNull() | (F.col("rank") <= F.col("last"))).groupBy("case_id").agg(F.count_if("good").alias("ok"), F.count("*").alias("returned"))
    held = cases.join(recall, "case_id", "left").join(current, "case_id", "left").fillna(0, ["want", "found", "ok", "returned"])
    return held.select("case_id", "expect_abstain", "expect_fail", "found", "want", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), "ok", "returned", (F.col("expect_abstain") == (F.col("returned") == 0)).alias("abstain_ok"))


def summary(metrics: DataFrame) -> DataFrame:
    """recall and current over all expected and returned, mrr over cases that expect something, abstain over cases.

    Cases that are expected to fail are only counted, and those of them that found all they want.
    """
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    known, asks = ~F.col("expect_fail"), F.col("want") > 0
    total = lambda name: F.coalesce(F.sum(F.when(known, F.col(name))), F.lit(0))
    return metrics.agg(
        F.count_if(known).alias("cases"),
        F.count_if(known & asks).alias("recall_cases"),
        F.count_if(known & (F.col("returned") > 0)).alias("current_cases"),
        F.count_if(~known).alias("gap_cases"),
        F.count_if(~known & asks & (F.col("found") == F.col("want"))).alias("gap_passes"),
        F.round(share(total("found"), total("want")), 6).alias("recall"),
        F.round(share(F.sum(F.when(known & asks, F.col("reciprocal_rank")).otherwise(0.0)), F.count_if(known & asks)), 6).alias("mrr"),
        F.round(share(total("ok"), total("returned")), 6).alias("current"),
        F.round(share(F.count_if(known & F.col("abstain_ok")), F.count_if(known)), 6).alias("abstain"),
    )


def case_rows(metrics: DataFrame) -> DataFrame:
    """A report's line for each case: whether it abstained, found of wanted, the first hit's rank (null without one), the share of current hits, and how it came out."""
    gap = F.when((F.col("want") > 0) & (F.col("found") == F.col("want")), "GAP-PASS").otherwise("GAP")
    return metrics.select(
        "case_id", (F.col("returned") == 0).alias("abstained"), F.concat_ws("/", F.col("found").cast("string"), F.col("want").cast("string")).alias("recall"),
        F.when(F.col("reciprocal_rank") > 0, F.round(1 / F.col("reciprocal_rank")).cast("int")).alias("rank"), F.when(F.col("returned") > 0, F.round(100 * F.col("ok") / F.col("returned"))).otherwise(0.0).cast("int").alias("current"),
        F.when(F.col("expect_fail"), gap).when(F.col("abstain_ok"), "PASS").otherwise("FAIL").alias("outcome"))


def dry_run(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """One row, without a search: how many cases there are, of which kind, and the summary of nothing found. A case that abstains counts as that only."""
    kinds = cases.agg(F.count("*").alias("total"), F.count_if(~F.col("expect_abstain") & ~F.col("expect_fail")).alias("in_scope"), F.count_if("expect_abstain").alias("abstaining"), F.count_if(~F.col("expect_abstain") & F.col("expect_fail")).alias("failing"))
    none = expected.limit(0).select("case_id", F.lit(0).alias("rank"), *KEYS, F.lit(False).alias("is_current"))
    return kinds.crossJoin(F.broadcast(summary(case_metrics(cases, expected, none))))


#: Where a metric has data: its denominator's count of cases.
_CASES = {"recall": "recall_cases", "mrr": "recall_cases", "current": "current_cases", "abstain": "cases"}


def gate(summary: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """metric, value, floor of every metric below its floor; a floor of 0 and a metric without cases gate nothing."""
    floors = FLOORS if floors is None else floors
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(float(f)).alias("floor"), F.col(_CASES[k]).alias("n")) for k, f in floors.items()]))
    return summary.select(each.alias("m")).select("m.*").filter("n > 0 and floor > 0 and value < floor").drop("n")


def report(rows: list[dict], columns: list[str]) -> str:
    """A table of fixed width, rows as they come."""
    cells = [columns, *([str(r[c]) for c in columns] for r in rows)]
    widths = [max(len(x[k]) for x in cells) for k in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in cells)


def report_json(meta: dict, cases: list[dict], aggregate: dict) -> dict:
    return {"schema_version": 1, **meta, "aggregate": aggregate, "cases": cases}


def lanes(cases: DataFrame, expected: DataFrame, hits: DataFrame, pinned_hits: DataFrame) -> dict[str, DataFrame]:
    """Summaries of the open lane, whose searches name no framework, and of the pinned one, and the gate, which stands on the open lane only."""
    found = {"open": summary(case_metrics(cases, expected, hits)), "pinned": summary(case_metrics(cases, expected, pinned_hits))}
    return found | {"gate": gate(found["open"])}


def pool_recall(expected: DataFrame, pool: DataFrame) -> DataFrame:
    """How much of what is expected a deeper pool of hits holds, over all cases: found, want, recall."""
    low = [F.lower(k).alias(k) for k in KEYS]
    have = pool.select("case_id", *low).distinct().withColumn("hit", F.lit(1))
    held = expected.select("case_id", *low).join(have, ["case_id", *KEYS], "left")
    return held.agg(F.count("hit").alias("found"), F.count("*").alias("want"), F.when(F.count("*") > 0, F.round(F.count("hit") / F.count("*"), 6)).otherwise(0.0).alias("recall"))
