"""URL filters: path rules first, then trust and distrust carried along the links between hosts.

Trust starts at hosts with an allowed page and follows links forward as a personalised PageRank. Distrust starts at
hosts most of whose pages a rule blocks and follows links backward: who links to bad hosts is suspect. A host's share
of distrust in both scores is held against a threshold. Steps go on, in blocks of ITERATIONS, until no host is newly
reached and no score changes by more than TOLERANCE of itself; each block ends with one aggregate of one row. Everything
is DataFrame operations; host edges and seeds are written once, so that no iteration parses a page again.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Nulls in
html give no links. Repeated rows stay, each with its verdict. An empty table gives no rows. Columns of the input
other than those named do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, lower_ascii, table

#: Action and rule, `host/path-prefix`.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'>\s]+)"""
ITERATIONS = 8
#: Largest change of any score in the last step, as a part of the score.
TOLERANCE = 1e-8
#: Scores below it count as settled: doubles end soon after.
_SMALL = 1e-290
DAMPING = 0.85
THRESHOLD = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) over hosts, of absolute links; a host's links to itself say nothing and are left out."""
    found = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    found = found.select(F.col("host").alias("src"), lower_ascii(F.col("dst")).alias("dst"))
    return found.filter("src <> '' and src <> dst").distinct()


def host_seeds(ruled: DataFrame) -> DataFrame:
    """(kind, host, s): trusted hosts have an allowed page, distrusted ones a rule that blocks most of their pages. Each kind's s sums to 1."""
    by_host = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked"))
    kinds = F.array_compact(F.array(F.when(F.col("allowed") > 0, F.lit("trust")), F.when(2 * F.col("blocked") > F.col("n"), F.lit("distrust"))))
    seeds = by_host.select(F.explode(kinds).alias("kind"), "host")
    totals = seeds.groupBy("kind").agg(F.count("*").alias("of"))  # two rows at most
    return seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.lit(1.0) / F.col("of")).alias("s"))


def propagate(links: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, cut_every: int = 4, tolerance: float | None = None) -> DataFrame:
    """(kind, host, score) after so many steps of personalised PageRank: trust along the links, distrust against them.

    With a tolerance, blocks of so many steps follow one another until no score changes by more than this part of itself
    in the last step; a host reached in that step has changed by all of its score. This is an action a block.

    links: (src, dst), distinct. seeds: (kind, host, s). A host without links passes nothing on. Both kinds move in
    the same join; each step is one join and one sum on the same key, with partial sums before the shuffle.
    """
    steps = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"))
    steps = steps.unionAll(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    out = steps.groupBy("kind", "host").agg(F.count("*").alias("out"))
    steps = durable(steps.join(out, ["kind", "host"]).select("kind", "host", "to", (F.lit(damping) / F.col("out")).alias("w")), "host-steps")
    seeds = durable(seeds, "host-seeds")
    start = seeds.select("kind", "host", (F.col("s") * (1 - damping)).alias("score"))
    scores = seeds.withColumnRenamed("s", "score")
    settled = False
    while not settled:
        for i in range(1, iterations + 1):
            moved = scores.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("w")).alias("score"))
            new = start.unionAll(moved)
            if tolerance is not None and i == iterations:
                both = new.withColumn("before", F.lit(0.0)).unionAll(scores.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before")))
                scores = durable(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "host-scores")
            else:
                scores = new.groupBy("kind", "host").agg(F.sum("score").alias("score"))
                if i % cut_every == 0 and i < iterations:
                    scores = durable(scores, "host-scores")
        if tolerance is None:
            return scores
        change = F.abs(F.col("score") - F.col("before")) / F.greatest("score", F.lit(_SMALL))
        settled = (scores.agg(F.max(change)).first()[0] or 0.0) <= tolerance
        scores = scores.drop("before")
    return scores


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, iterations: int = ITERATIONS, damping: float = DAMPING, tolerance: float | None = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, distrust of every page; distrust is the host's share, null where no score reached it.

    A page that no rule fits is blocked if its host's share of distrust is over the threshold. iterations and tolerance
    are as in `propagate`.
    """
    host, path = url_parts(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumns({"rule": rule, "action": action})
    scores = propagate(host_links(ruled), host_seeds(ruled.drop("html")), iterations, damping, tolerance=tolerance)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    shares = scores.groupBy("host").agg((part("distrust") / (part("distrust") + part("trust"))).alias("distrust"))
    verdict = F.coalesce("action", F.when(F.col("distrust") > threshold, "block"), F.lit("allow"))
    return ruled.drop("html").join(shares, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("distrust", 6).alias("distrust"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}')".format(*r.split("/", 1))
    case = lambda what: "case " + " ".join(f"when {fits(r)} then '{what(a, r)}'" for a, r in rules) + " end"
    steps = "".join(
        f""", r{i} as materialized (select kind, host, sum(score) as score from (
            select kind, host, s * {1 - DAMPING} as score from seeds
            union all select s.kind, s.dst, r.score * s.w from r{i - 1} r join steps s on s.kind = r.kind and s.host = r.host) group by 1, 2)"""
        for i in range(1, ITERATIONS + 1)
    )
    return f"""
with cut as (select page_id, html,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
    ruled as materialized (select *, {case(lambda a, r: r)} as rule, {case(lambda a, r: a)} as action from cut),
    links as materialized (select distinct host as src, dst from (select host, translate(unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from ruled) where host <> '' and host <> dst),
    both_ways as (select 'trust' as kind, src as host, dst from links union all select 'distrust', dst, src from links),
    steps as materialized (select *, {DAMPING} / count(*) over (partition by kind, host) as w from both_ways),
    hosts as materialized (select host, count(*) as n, count(*) filter (action = 'allow') as allowed, count(*) filter (action = 'block') as blocked from ruled where host <> '' group by 1),
    picked as (select 'trust' as kind, host from hosts where allowed > 0 union all select 'distrust', host from hosts where 2 * blocked > n),
    seeds as materialized (select kind, host, 1.0::double / count(*) over (partition by kind) as s from picked),
    r0 as materialized (select kind, host, s as score from seeds){steps},
    shares as (select host, sum(score) filter (kind = 'distrust') as d, sum(score) as both_kinds from r{ITERATIONS} group by 1),
    shared as (select host, coalesce(d, 0) / both_kinds as distrust from shares)
select page_id, ruled.host, path, rule, coalesce(action, case when distrust > {THRESHOLD} then 'block' end, 'allow') as verdict, round(distrust, 6) as distrust
from ruled left join shared on shared.host = ruled.host"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _sql()}
