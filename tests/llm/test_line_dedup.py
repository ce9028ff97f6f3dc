from tessera.llm import line_dedup as ld
from tests.compare import same


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def run(spark, docs, least=50):
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, place string, n_removed int")
    return sorted(((r.doc_id, r.text, r.n_removed) for r in ld.dedup_lines(df, least).collect()), key=repr)


def test_whole_table_matches_sql(spark, sf_dir):
    same(spark, sf_dir, ld.op5_line_dedup, ld.ORACLES["op5_line_dedup"])


def test_runs(spark):
    passage = "\n".join(words(t, 20) for t in "abc")
    short = "\n".join(words(t, 10) for t in "de")
    docs = [(1, f"head one\n{passage}\n{short}\ntail"), (2, f"other\n{passage}\nmore"), (3, short), (4, words("long", 60)), (5, f"x\n  {words('long', 60)}  \ny"), (6, "\n".join([words("r", 30)] * 4))]
    got = {d: (t, n) for d, t, n in run(spark, docs)}
    assert got[1] == (docs[0][1], 0) and got[2] == ("other\nmore", 3) and got[3] == (short, 0)
    assert got[4][1] == 0 and got[5] == ("x\ny", 1) and got[6] == (words("r", 30), 3)


def test_run_that_is_extended_both_ways(spark):
    lines = [words(f"k{k}_", 9) for k in range(12)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["mine", *lines[2:10], "own"])), (3, "\n".join(lines[5:8]))]
    got = {d: (t, n) for d, t, n in run(spark, docs)}
    assert got[2] == ("mine\nown", 8) and got[3][1] == 0


def test_odd_rows(spark):
    text = words("p", 70)
    docs = [(None, text), (2, text), (2, text), (3, None), (4, ""), (5, "\n\n"), (7, " a\n" + text)]
    got = run(spark, docs)
    assert (2, text, 0) in got and got.count((2, text, 0)) == 2
    assert (None, "", 1) in got and (3, None, 0) in got and (4, "", 0) in got and (5, "\n\n", 0) in got and (7, " a", 1) in got
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert ld.dedup_lines(df.limit(0)).count() == 0


def brute(docs, least):
    """Removed line numbers by doc, over all earlier places; docs: (doc_id, text) in order of doc_id, all lines with words."""
    removed = {}
    held = [(d, t.split("\n")) for d, t in docs]
    for late, (d, x) in enumerate(held):
        gone = set()
        for early in range(late + 1):
            y = held[early][1]
            for shift in range(1 if early == late else 1 - len(y), len(x)):
                run = []
                for k in range(len(x) + 1):
                    if k < len(x) and 0 <= k - shift < len(y) and x[k] == y[k - shift]:
                        run.append(k)
                        continue
                    if sum(len(x[i].split()) for i in run) >= least:
                        gone.update(run)
                    run = []
        removed[d] = gone
    return removed


def test_against_all_earlier_places(spark):
    import random

    rng = random.Random(5)
    pool = [words(f"w{k}_", rng.choice([1, 2, 3, 5, 12])) for k in range(12)]
    docs = [(d, "\n".join(rng.choices(pool, k=rng.randint(1, 30)))) for d in range(40)]
    passages = [docs[rng.randrange(40)][1].split("\n")[:6] for _ in range(6)]
    docs += [(40 + d, "\n".join([*rng.choices(pool, k=3), *rng.choice(passages), *rng.choices(pool, k=3)])) for d in range(30)]
    want = brute(docs, 10)
    assert any(want.values())
    for d, t, n in run(spark, docs, 10):
        lines = dict(docs)[d].split("\n")
        assert n == len(want[d]) and t == "\n".join(x for k, x in enumerate(lines) if k not in want[d])


def test_passage_whose_least_line_stands_elsewhere(spark):
    lines = [words(f"p{k}_", 10) for k in range(6)]
    alone = [(k, f"head{k}\n{x}\ntail{k}") for k, x in enumerate(lines)]  # every line has an earlier place outside the passage
    docs = [*alone, (10, "\n".join(["b", *lines, "b2"])), (11, "\n".join(["c", lines[3], "c2", *lines, "c3"]))]
    got = {d: (t, n) for d, t, n in run(spark, docs)}
    assert got[10] == (docs[6][1], 0) and got[11] == (f"c\n{lines[3]}\nc2\nc3", 6)


def test_windows_without_a_shared_fingerprint_end(spark):
    own = lambda k: "\n".join(f"line {j} of text {k} " + "and so on " * 6 for j in range(12))
    shared = "\n".join(f"shared line {j} " + "word " * 20 for j in range(4))
    docs = spark.createDataFrame([(k, own(k) + ("\n" + shared if k in (3, 7) else "")) for k in range(10)], "doc_id long, text string")
    runs = ld.runs_of(ld.lines_of(docs), 50)
    kept = ld.matching(runs).select("doc", "start", "end").distinct().collect()
    assert {r.doc for r in kept} == {3, 7} and len(kept) < runs.count() / 4
    assert {(r.doc, r.start) for r in ld.later_runs(runs).collect()} <= {(r.doc, r.start) for r in kept}
    out = {r.doc_id: r.n_removed for r in ld.dedup_lines(docs).collect()}
    assert out == {k: 4 if k == 7 else 0 for k in range(10)}


def test_very_long_and_invalid_texts(spark):
    line = "a line of ten words that stands in very many places "
    bad = spark.sql("select 5L as doc_id, cast(X'61ff62' as string) as text")
    docs = spark.createDataFrame([(1, (line * 6 + "\n") * 3000), (2, "x" * 500_000 + "\n" + line * 6)], "doc_id long, text string").unionByName(bad)
    got = {r.doc_id: r for r in ld.dedup_lines(docs).collect()}
    assert got[1].n_removed == 2999 and got[2].n_removed == 1 and got[2].text == "x" * 500_000 and got[5].n_removed == 0
