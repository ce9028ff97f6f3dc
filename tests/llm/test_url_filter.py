from tessera.llm import url_filter
from tests.compare import same


def test_whole_table_matches_sql(spark, sf_dir):
    same(spark, sf_dir, url_filter.op1_url_filter, url_filter.ORACLES["op1_url_filter"])


def test_odd_rows_and_propagation(spark):
    link = lambda host: f'<a HREF="https://{host}/x">'
    rows = [
        (1, "https://Example.COM/en/7x?q", None), (2, "http://a.com/en/", link("b.io")), (3, "http://a.com/en/z", None), (4, "http://c.io/", link("a.com")),
        (5, "http://b.io/#f", None), (6, None, None), (7, "nothing", "x"), (8, "http://x.net/de/1", link("d.io")), (9, "http://d.io", None), (9, "http://d.io", None), (None, "http://example.com/en/8", ""),
    ]
    df = spark.createDataFrame([(*r, "dup") for r in rows], "page_id long, url string, html string, host string")
    got = [tuple(r)[:5] for r in url_filter.filter_urls(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1] == (1, "example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[2][3:] == ("com/en/", "block") and by[None][3:] == ("com/en/", "block")
    assert by[6][1:] == ("", "", None, "allow") and by[7][1:] == ("", "", None, "allow")
    assert by[4][4] == "block"  # links to a distrusted host
    assert by[5][4] == "allow" and by[9][4] == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_propagation_against_plain_loops(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    seeds = {("trust", "a"): 0.5, ("trust", "d"): 0.5, ("distrust", "c"): 1.0}
    score = dict(seeds)
    for _ in range(8):
        new = {k: 0.15 * v for k, v in seeds.items()}
        for kind, pairs in (("trust", links), ("distrust", [(y, x) for x, y in links])):
            for x, y in pairs:
                out = sum(a == x for a, _ in pairs)
                if (kind, x) in score:
                    new[kind, y] = new.get((kind, y), 0) + 0.85 * score[kind, x] / out
        score = new
    got = url_filter.propagate(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(*k, v) for k, v in seeds.items()], "kind string, host string, s double")).collect()
    assert {(r.kind, r.host) for r in got} == set(score) and all(abs(r.score - score[r.kind, r.host]) < 1e-9 for r in got)


def test_propagation_until_it_settles(spark):
    chain = [(f"h{k}", f"h{k + 1}") for k in range(12)]
    links = [*chain, ("h3", "h1"), ("h5", "x"), ("x", "h2")]
    seeds = {("trust", "h0"): 1.0, ("distrust", "h12"): 0.5, ("distrust", "h5"): 0.5}
    score = dict(seeds)
    for _ in range(300):
        new = {k: 0.15 * v for k, v in seeds.items()}
        for kind, pairs in (("trust", links), ("distrust", [(y, x) for x, y in links])):
            for x, y in pairs:
                if (kind, x) in score:
                    new[kind, y] = new.get((kind, y), 0) + 0.85 * score[kind, x] / sum(a == x for a, _ in pairs)
        score = new
    got = url_filter.propagate(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(*k, v) for k, v in seeds.items()], "kind string, host string, s double"), tolerance=1e-4).collect()
    assert {(r.kind, r.host) for r in got} == set(score) and all(abs(r.score - score[r.kind, r.host]) < 1e-3 * score[r.kind, r.host] for r in got)


def test_distrust_goes_further_than_eight_links(spark):
    hosts = [f"h{k}.io" for k in range(12)]
    rows = [(k, f"http://{h}/", f'<a href="//{hosts[k + 1]}/">' if k < 11 else '<a href="//bad.com/">') for k, h in enumerate(hosts)] + [(99, "http://bad.com/en/1", None)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"} and len(got) == 13


def test_very_long_and_invalid_rows(spark):
    bad = spark.sql("select 1L as page_id, cast(X'687474703a2f2f61ff2e636f6d2f656e2f' as string) as url, cast(X'3c61ff' as string) as html")
    long = spark.createDataFrame([(2, "http://example.com/en/" + "x" * 300_000, "<a href='http://b.io/'>" * 20_000), (3, "http://" + "a." * 2000 + "org/es/", "y" * 500_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(bad.unionByName(long)).collect()}
    assert got[1].verdict == "block" and got[2].verdict == "block" and got[3].verdict == "block" and len(got[2].path) == 300_004
