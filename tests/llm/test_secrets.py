import hashlib
import re

from tessera.llm import secrets

KEY, ACCESS = "aB3" * 10, "AKIA" + "X7" * 8


def base(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = secrets.op10_secrets(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


def kinds(spark, docs):
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, key string")
    return {r.doc_id: [p.kind for p in r.spans] for r in secrets.scan_secrets(df).collect()}


def test_weak_parts_need_their_complement(spark):
    far = " word" * 100
    docs = [
        (1, f"login: alice and {KEY}"), (2, f"login: alice{far} {KEY}"), (3, f"only {KEY} here"), (4, "login: alice only"), (5, f"{ACCESS} then {KEY}"),
        (6, f"https://h.example/x login: bob {KEY}"), (7, f"https://h.example/x {KEY}"), (8, f'user="bob" token = "{"0123456789abcdef" * 3}"'), (9, None), (10, ""),
    ]
    got = kinds(spark, docs)
    assert got[1] == ["id", "key"] and got[2] == [] and got[3] == [] and got[4] == [] and got[5] == ["access", "key"]
    assert got[6] == ["endpoint", "id", "key"] and got[7] == [] and got[8] == ["id", "assign", "hex"] and got[9] == [] and got[10] == []


def test_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    pool = [f"login: u{rng.random()}", KEY, ACCESS, "https://h.example/q", "token = abcdefgh1", "word " * 30]
    docs = [(k, " ".join(rng.choices(pool, k=12))) for k in range(40)]
    got = {d: s for d, s in ((r.doc_id, [tuple(p) for p in r.spans]) for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect())}
    for d, text in docs:
        parts = secrets.parts_of(text)
        near = lambda p, role: any(secrets.KINDS[q[1]] == role and q != p and q[0] <= p[2] + 200 and p[0] <= q[2] + 200 for q in parts)  # noqa: B023, E731
        ok = lambda p: p[1] in secrets.STRONG or {"id": near(p, "secret"), "key": near(p, "id"), "endpoint": near(p, "id") and near(p, "secret")}[p[1]]  # noqa: B023, E731
        assert sorted(got[d]) == sorted(p for p in parts if ok(p))


def test_mask(spark):
    docs = [(1, f"a token = abcdefgh12 b {ACCESS}."), (1, f"a token = abcdefgh12 b {ACCESS}."), (2, "clean"), (3, None), (None, "éé secret: longenough1")]
    got = sorted(((r.doc_id, r.text, r.extra) for r in secrets.mask_secrets(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, extra int")).collect()), key=repr)
    assert got == sorted([(1, "a [SECRET] b [SECRET].", 1)] * 2 + [(2, "clean", 1), (3, None, 1), (None, "éé [SECRET]", 1)], key=repr)
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_keys(spark):
    import random

    rng = random.Random(3)
    keys = {n: "aB3" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789+/", k=n - 5)) + "==" for n in (64, 65, 88, 300, 5000)}
    docs = [(n, f"https://h.example/x {ACCESS} {key} end") for n, key in keys.items()] + [(-n, f"only {key} end") for n, key in keys.items()]
    got = kinds(spark, docs)
    assert all(got[n] == ["endpoint", "access", "key"] and got[-n] == [] for n in keys)
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(masked[n] == "[SECRET] [SECRET] [SECRET] end" for n in keys)
