"""Quality rules: counts first, then how far a document's histograms lie from its language's.

Two histograms are taken of each text, of character classes and of its language's common words. A language is a value of
`lang` down to its first part, two or three letters, so there are 18,252 at most; its common words are the TOP that the
most of its documents hold, and its reference is the mean of its documents' histograms, both learned from the whole table,
whatever number of documents that is. A document is held against its own language's reference. Where that is far, and
for a text that no language is marked on, the reference whose words are nearest is tried. A text that is marked goes if
the Jensen-Shannon distance of either histogram is over its limit to both. A text that is not marked may be of a language
that the table does not have, so it is judged by its characters alone then, letters of all scripts being one class: it goes
if these are far from every reference. Texts too short to tell are not judged by distance.

The text is read twice, in Python: for the words that documents hold, of which each task sends a count by language and
word, and for a narrow table of counts. References are one aggregation of that table, summed in each task first, and
distances a pass over it.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows stay, each judged. A text that
is alone in its language is its own reference, and no distance away. Where no document is marked no distance is taken.
Very long texts are read whole. Text that is no valid UTF-8 is counted by its bytes. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

#: Common words of a language.
TOP = 20
#: Common words of four languages, for features that do not learn them.
LANGUAGES = {
    "de": "der die das und in zu den von mit ist des auf für nicht ein eine dem sich auch als",
    "en": "the of and to in a is that for it as was with be by on not he this are",
    "es": "de la que el en y a los del se las por un para con no una su al es",
    "fr": "de la le et les des en un du une que est pour qui dans a par sur pas au",
}
COMMON = sorted({w for words in LANGUAGES.values() for w in words.split()})

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Below these a histogram says too little: words, and characters.
GUARD_WORDS, GUARD_CHARS = 50, 200
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.38

_SPACE, _SYMBOL, _OTHER_SCRIPT, _CLASSES = 1, 6, 9, 10
_CLASS = np.full(256, 7, np.uint8)  # other ASCII
_CLASS[0x80:0xC0] = 0  # later bytes of a character
_CLASS[0xC0:] = 8
_CLASS[[*range(0xCE, 0xE2), *range(0xE3, 0xEE)]] = _OTHER_SCRIPT  # first bytes of Greek to Thai and of kana to Hangul
for _k, _chars in ((_SPACE, b" \t\n\r\v\f"), (2, bytes(range(97, 123))), (3, bytes(range(65, 91))), (4, b"0123456789"), (5, b".,;:!?'\"()-"), (_SYMBOL, b"#*$%&|<>")):
    _CLASS[list(_chars)] = _k


def _plain(word: bytes) -> str:
    """A word in lower case without the punctuation around it."""
    return word.decode(errors="replace").lower().strip(".,;:!?'\"()")


_FIXED = {w: k + 1 for k, w in enumerate(COMMON)}


class _Words(dict):
    """Slot (0: none; by default in COMMON) and hash of a word. Emptied when it is full."""

    def __init__(self, slots: dict[str, int] = _FIXED):
        super().__init__()
        self.slots = slots

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = self.slots.get(_plain(word), 0), xxhash.xxh3_64_intdigest(word)
        return found


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that are found twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[:n] += twice
    cover[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\v\f")]
    return len(lines) - len(set(lines))


def language(lang: Column) -> Column:
    """The first part of a language tag, of two or three letters, in lower case; null for what is none."""
    found = F.regexp_extract(F.lower(F.trim(lang.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text as bytes."""
    lang = language(F.col("lang")) if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def common_words(docs: DataFrame, top: int = TOP) -> dict[str, list[str]]:
    """Of each language the words that the most of its documents hold, ties in order of the words."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[bytes]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, word.decode(errors="replace"), n) for lang, own in found.items() for word, n in own.items() if word]
            found.clear()
            langs, words, times = zip(*rows) if rows else ((), (), ())
            return pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().split()
                if len(words) >= GUARD_WORDS:
                    found.setdefault(lang, Counter()).update(set(map(plain.__getitem__, set(words))))
            if sum(map(len, found.values())) > 500_000:
                yield flush()
                plain.clear()
        yield flush()

    class Plain(dict):
        def __missing__(self, word: bytes) -> bytes:
            self[word] = p = _plain(word).encode(errors="replace")
            return p

    plain = Plain()
    each = _marked(docs).filter("lang is not null").select("lang", "text").mapInArrow(held, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, list[str]] = {}
    for r in each.withColumn("rank", rank).filter(F.col("rank") <= top).orderBy("lang", "rank").collect():  # `top` words of each language
        out.setdefault(r.lang, []).append(r.word)
    return out


def counts(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, and which of all languages' common words stand in the text how often."""
    kind = dict(docs.dtypes)["doc_id"]
    slots = {w: k + 1 for k, w in enumerate(sorted({w for own in words.values() for w in own}))}
    out = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(c, pa.list_(pa.int32())) for c in ("chars", "slots", "times")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(slots)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                held = text.split()
                found = list(map(known.__getitem__, held))
                at, hashes = zip(*found) if found else ((), ())
                classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_CLASSES)
                times = np.bincount(np.array(at, np.int64), minlength=1)
                some = np.flatnonzero(times[1:]) + 1
                rows.append((len(held), int(classes[1:].sum() - classes[_SPACE]), int(classes[_SYMBOL]), duplicate_lines(text), repeated_words(np.array(hashes, np.uint64)), classes[1:].astype(np.int32), some.astype(np.int32), times[some].astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), *(pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(out), out))], ["doc_id", "lang", *out.names])

    numbers = ", ".join(f"{c} bigint" for c in out.names[:5])
    return _marked(docs).mapInArrow(scan, f"doc_id {kind}, lang string, {numbers}, chars array<int>, slots array<int>, times array<int>")


@dataclass
class Reference:
    """A language: slots of its common words in order, mean shares of character classes, and of its words and all others."""

    lang: str
    slots: np.ndarray
    chars: np.ndarray
    common: np.ndarray

    @staticmethod
    def shares(slots: np.ndarray, rows: Histograms) -> np.ndarray:
        """Shares of the words in these slots, and of all others."""
        place = np.full(max(rows.most, int(slots.max(initial=0))) + 1, -1)
        place[slots] = np.arange(len(slots))
        at = place[rows.slots]
        out = np.zeros((len(rows.words), len(slots) + 1))
        np.add.at(out, (rows.owner[at >= 0], at[at >= 0]), rows.times[at >= 0])
        out[:, -1] = rows.words - out.sum(1)
        return out / np.maximum(rows.words, 1)[:, None]


class Histograms:
    """Rows of counts() side by side."""

    def __init__(self, words, chars, slots, times):
        self.words = np.asarray(words, float)
        raw = np.array(list(chars), float).reshape(len(self.words), _CLASSES - 1)
        self.chars = raw / np.maximum(raw.sum(1, keepdims=True), 1)
        self.owner = np.repeat(np.arange(len(self.words)), [len(s) for s in slots]).astype(np.int64)
        self.slots = np.concatenate([np.zeros(0, np.int64), *[np.asarray(s, np.int64) for s in slots]])
        self.times = np.concatenate([np.zeros(0), *[np.asarray(t, float) for t in times]])
        self.most = int(self.slots.max(initial=0))

    def take(self, rows: np.ndarray) -> Histograms:
        out = object.__new__(Histograms)
        number = np.full(len(self.words), -1)
        number[rows] = np.arange(len(rows))
        own = number[self.owner] >= 0
        out.words, out.chars, out.most = self.words[rows], self.chars[rows], self.most
        out.owner, out.slots, out.times = number[self.owner[own]], self.slots[own], self.times[own]
        return out


def references(counted: DataFrame, words: dict[str, list[str]]) -> list[Reference]:
    """The references of all languages, in order of their names."""
    slots = {w: k + 1 for k, w in enumerate(sorted({w for own in words.values() for w in own}))}
    own_slots = {lang: np.array([slots[w] for w in own]) for lang, own in words.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = Histograms(*(batch.column(c).to_pylist() for c in ("n_words", "chars", "slots", "times")))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()) & own_slots.keys():
                own = rows.take(np.flatnonzero(langs == lang))
                held = np.concatenate([[len(own.words)], own.chars.sum(0), Reference.shares(own_slots[lang], own).sum(0)])
                found[lang] = found.get(lang, 0) + held
        for lang, values in found.items():
            yield pa.record_batch([pa.array([lang] * len(values)), pa.array(np.arange(len(values))), pa.array(values)], ["lang", "slot", "value"])

    judged = counted.filter(F.col("lang").isNotNull() & (F.col("n_words") >= GUARD_WORDS)).select("lang", "n_words", "chars", "slots", "times")
    held: dict[str, list[float]] = {}
    for r in judged.mapInArrow(sums, "lang string, slot bigint, value double").groupBy("lang", "slot").agg(F.sum("value").alias("value")).orderBy("lang", "slot").collect():
        held.setdefault(r.lang, []).append(r.value)
    return [Reference(lang, own_slots[lang], (x := np.array(v[1:]) / v[0])[: _CLASSES - 1], x[_CLASSES - 1 :]) for lang, v in held.items()]


def _one_script(chars: np.ndarray) -> np.ndarray:
    """Shares of character classes with letters of all scripts as one class, but for capitals of ASCII."""
    out = chars.copy()
    out[:, 1] += out[:, 7] + out[:, _OTHER_SCRIPT - 1]
    out[:, [7, _OTHER_SCRIPT - 1]] = 0
    return out


def nearest(rows: Histograms, langs: list[str | None], known: list[Reference], char_limit: float, word_limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, character and word distance of each row: of its own language where it is not far, else of the one whose words are nearest; an unmarked row that is far from it has neither language nor word distance, and a character distance only if its characters are far from all."""
    n = len(rows.words)
    picked, chars, common = np.full(n, None, object), np.full(n, np.nan), np.full(n, np.nan)
    names = {r.lang: r for r in known}
    marks = np.array([x if x in names else None for x in langs], object)
    far = lambda at: (chars[at] > char_limit) | (common[at] > word_limit)

    def hold(ref: Reference, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = rows.take(at)
        return js_distance(own.chars, ref.chars), js_distance(Reference.shares(ref.slots, own), ref.common)

    for lang in {x for x in marks.tolist() if x is not None}:
        at = np.flatnonzero(marks == lang)
        picked[at] = lang
        chars[at], common[at] = hold(names[lang], at)
    again = np.flatnonzero((marks == None) | far(np.arange(n)))  # noqa: E711
    if len(again) and known:
        each = [hold(r, again) for r in known]
        best = np.argmin([w for _, w in each], 0)
        row = np.arange(len(again))
        c, w = np.array([c for c, _ in each])[best, row], np.array([w for _, w in each])[best, row]
        near = (c <= char_limit) & (w <= word_limit)
        at = again[near]
        picked[at], chars[at], common[at] = np.array([r.lang for r in known], object)[best[near]], c[near], w[near]
        lost = again[~near & (marks[again] == None)]  # noqa: E711
        if len(lost):
            least = np.min([js_distance(_one_script(rows.take(lost).chars), _one_script(r.chars[None])[0]) for r in known], 0)
            chars[lost] = np.where(least > char_limit, least, np.nan)
    return picked, chars, common


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, to the base of 2, of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, language, char_distance, word_distance."""
    words = common_words(docs)
    counted = durable(counts(docs, words), "rule-counts")
    known = references(counted, words)

    @F.pandas_udf("language string, char_distance double, word_distance double")
    def distances(lang: pd.Series, n_words: pd.Series, chars: pd.Series, slots: pd.Series, times: pd.Series) -> pd.DataFrame:
        found = nearest(Histograms(n_words, chars, slots, times), [x if isinstance(x, str) else None for x in lang], known, char_limit, word_limit)
        return pd.DataFrame(dict(zip(("language", "char_distance", "word_distance"), found, strict=True)))

    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    guard = (F.col("n_words") >= GUARD_WORDS) & (F.col("word_chars") >= GUARD_CHARS)
    over = lambda c, limit: F.coalesce(~F.isnan(c) & (F.col(c) > limit), F.lit(False))
    far = guard & (over("d.char_distance", char_limit) | over("d.word_distance", word_limit))
    judged = counted.withColumn("d", distances("lang", "n_words", "chars", "slots", "times"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~far).alias("kept"), "d.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES: dict[str, str] = {}
