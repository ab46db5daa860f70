"""op6: language identification with language-bitmask n-gram filters.

Character n-grams of letters and word ends belong to every language in which
they are about as frequent as anywhere. One bit-sliced Bloom filter holds all of
them: a slot is a mask with one bit per language, an n-gram sets its languages'
bits in ``HASHES`` slots, and the AND of these slots returns, in one look-up, all
languages containing the n-gram. A document's n-grams are looked up, each
language's bits counted, and the counts corrected for the filter's false
positives: with a fill f_l of language l's slice an absent n-gram passes with
p_l = f_l ** HASHES, so hits h of n stand for (h - n p_l) / (1 - p_l). The
highest corrected count decides.

Training reads text and lang only, of documents whose crc32(doc_id) mod 5 isn't 0,
and of these a hashed sample of about ``TRAIN_DOCS``, the same part of it for each
language: the bound on what is learned from. The filter has ``SLOTS_PER_GRAM`` slots
for each n-gram up to ``MAX_SLOTS``, the bound on its broadcast; a fuller one has
more false positives, which the correction takes into account. Every document is
predicted from its whole text.

Defined results: ``und`` with score 0 for null texts and texts without letters;
ties go to the first language in order; a null ``doc_id`` is not held out and not
learned from; without any labelled document all are ``und``. ``score`` is the
winner's share of all corrected counts. Other columns may be carried with
``keep`` under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, sent, table

SIZES = (3, 4)
#: About so many labelled documents are learned from.
TRAIN_DOCS = 20_000
#: An n-gram is a language's if this share of its documents has it ...
MIN_RATE = 0.004
MIN_DOCS = 2
#: ... and its rate there is this part of the highest.
MIN_PART = 0.4
HASHES = 3
SLOTS_PER_GRAM = 8
MAX_SLOTS = 1 << 22
#: Characters handled at once in a task; longer texts are taken in parts.
CHUNK_CHARS = 1 << 17

held_out_sql = "coalesce(crc32(cast(doc_id AS string)) % 5 = 0, false)"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> np.ndarray:
    """Lower-case letters, with one space for whatever else stands between them."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[at]
    at = np.where(letter, at, np.uint32(32))
    gap = ~letter
    keep = letter.copy()
    keep[1:] |= gap[1:] & letter[:-1]
    at = at[keep]
    return np.concatenate([[np.uint32(32)], at, [np.uint32(32)]]) if letter.any() else at[:0]


def _grams(points: np.ndarray, owner: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within one owner that begin at the first ``starts`` points, and their owners."""
    hashes, owners = [], []
    for n in SIZES:
        m = min(len(points) - n + 1, len(points) if starts is None else starts)
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ points[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        inside = owner[:m] == owner[n - 1 : m + n - 1]
        # the space between two words belongs to n-grams of one word only at their ends
        for i in range(1, n - 1):
            inside &= points[i : m + i] != 32
        hashes.append(h[inside])
        owners.append(owner[:m][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(n-grams, row of each, whether that is all of the rows) of a few texts at a time, or of a part of a long one.

    A part holds the n-grams that begin in it, so each is there once and none is cut.
    """
    parts, owners, size = [], [], 0
    for row in range(len(texts)):
        p = _points(texts[row].as_py() or "")
        if len(p) > CHUNK_CHARS:
            for begin in range(0, len(p), CHUNK_CHARS):
                part = p[begin : begin + CHUNK_CHARS + max(SIZES) - 1]
                yield *_grams(part, np.full(len(part), row), CHUNK_CHARS), False
        elif len(p):
            parts.append(p)
            owners.append(np.full(len(p), row))
            size += len(p)
            if size >= CHUNK_CHARS:
                yield *_grams(np.concatenate(parts), np.concatenate(owners)), True
                parts, owners, size = [], [], 0
    if size:
        yield *_grams(np.concatenate(parts), np.concatenate(owners)), True


def _distinct(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, row of each), each n-gram of a text once."""
    long: dict[int, np.ndarray] = {}
    for h, o, whole in _pieces(texts):
        by = np.lexsort((h, o))
        h, o = h[by], o[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[new], o[new]
        if whole:
            yield h, o
        elif len(o):
            long[o[0]] = np.union1d(long.get(o[0], h), h)
    for row, h in long.items():
        yield h, np.full(len(h), row)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, docs: how many of the language's documents have the n-gram; gram null: documents."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        code = {x: i for i, x in enumerate(names)}
        lang = np.array([code[x] for x in langs], np.int64)
        found = [(lang[o], h) for h, o in _distinct(batch.column(0))]
        for i, name in enumerate(names):
            mine = [h[x == i] for x, h in found]
            grams, docs = np.unique(np.concatenate(mine), return_counts=True) if mine else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(grams) + 1)),
                    pa.concat_arrays([pa.array(grams.view(np.int64)), pa.array([None], pa.int64())]),
                    pa.array(np.append(docs, (lang == i).sum()).astype(np.int64)),
                ],
                ["lang", "gram", "docs"],
            )


class Filter:
    """The bit-sliced Bloom filter; slots hold as many 64-bit words as the languages need."""

    def __init__(self, langs: list[str], grams: np.ndarray, masks: np.ndarray):
        self.langs = langs
        slots = 1 << max(6, int(np.ceil(np.log2(max(1, len(grams) * SLOTS_PER_GRAM)))))
        self.mask = np.uint64(min(slots, MAX_SLOTS) - 1)
        self.table = np.zeros((int(self.mask) + 1, masks.shape[1]), np.uint64)
        for slot in self._slots(grams):
            np.bitwise_or.at(self.table, slot, masks)
        fill = np.array([self._bit(self.table, i).mean() for i in range(len(langs))])
        self.false_positive = fill**HASHES

    def _slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            x = grams + np.uint64(i) * step
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            yield ((x ^ (x >> np.uint64(29))) & self.mask).astype(np.int64)

    @staticmethod
    def _bit(masks: np.ndarray, lang: int) -> np.ndarray:
        return (masks[:, lang >> 6] >> np.uint64(lang & 63)) & np.uint64(1)

    def hits(self, grams: np.ndarray, owner: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams by row, and by row and language those that the filter has."""
        masks = None
        for slot in self._slots(grams):
            masks = self.table[slot] if masks is None else masks & self.table[slot]
        seen = np.bincount(owner, minlength=n_rows)
        by_lang = [np.bincount(owner, weights=self._bit(masks, i).astype(float), minlength=n_rows) for i in range(len(self.langs))]
        return seen, np.array(by_lang).T

    def decide(self, seen: np.ndarray, hits: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = self.false_positive
        counts = np.maximum(0.0, (hits - seen[:, None] * p) / np.maximum(1e-9, 1 - p))
        total = counts.sum(axis=1)
        best = counts.argmax(axis=1)
        score = counts[np.arange(len(best)), best] / np.where(total > 0, total, 1)
        return [self.langs[b] for b in best], score


def learnable() -> Column:
    return F.expr(f"NOT {held_out_sql} AND doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Filter | None:
    """The filter of ``docs`` (doc_id, text, lang) that may be learned from."""
    rows = docs.where(learnable()).select("doc_id", "text", "lang")
    # Each language gets its part of the sample, so that rare ones are learned too.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = [x for k, n in sizes.items() if n * len(sizes) > train_docs for x in (F.lit(k), F.lit(int(train_docs / len(sizes) / n * (1 << 30))))]
    if part:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(F.create_map(*part)[F.col("lang")], F.lit(1 << 30)))
    counted = rows.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    counted = materialize(counted.where(f"gram IS NULL OR docs >= {MIN_DOCS}"), "lang-grams")
    total = counted.where("gram IS NULL").select("lang", F.col("docs").alias("n_docs"))
    langs = {r[0]: r[1] for r in total.collect()}
    if not langs:
        return None
    names = sorted(langs)
    size = F.create_map(*[x for k, v in langs.items() for x in (F.lit(k), F.lit(float(v)))])
    rate = counted.where(f"gram IS NOT NULL AND docs >= {MIN_DOCS}").withColumn("rate", F.col("docs") / size[F.col("lang")]).where(F.col("rate") >= MIN_RATE)
    by_gram = rate.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("l"))
    kept = by_gram.select("gram", F.transform(F.filter("l", lambda x: x["rate"] >= MIN_PART * F.col("top")), lambda x: x["lang"]).alias("langs"))
    code = {x: i for i, x in enumerate(names)}
    grams, masks = [], []
    # Bounded by the sample: an n-gram needs MIN_RATE of a language's documents.
    for r in kept.toLocalIterator():
        mask = [0] * ((len(names) + 63) // 64)
        for x in r["langs"]:
            mask[code[x] >> 6] |= 1 << (code[x] & 63)
        grams.append(r["gram"])
        masks.append(mask)
    by = np.argsort(np.array(grams, np.int64))
    discard(counted)
    return Filter(names, np.array(grams, np.int64)[by].view(np.uint64), np.array(masks, np.uint64).reshape(len(grams), -1)[by])


def _predict(batches: Iterator[pa.RecordBatch], model: Filter | None, first: int) -> Iterator[pa.RecordBatch]:
    """Columns of the batch from ``first`` on (the text is column 0), the language and the score."""
    for batch in batches:
        n = batch.num_rows
        seen = np.zeros(n, np.int64)
        langs, score = ["und"] * n, np.zeros(n)
        if model is not None and n:
            hits = np.zeros((n, len(model.langs)))
            for grams, owner, _ in _pieces(batch.column(0)):
                s, h = model.hits(grams, owner, n)
                seen += s
                hits += h
            best, score = model.decide(seen, hits)
            langs = [x if s else "und" for x, s in zip(best, seen, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(langs), pa.array(score)], [*batch.schema.names[first:], "lang_pred", "score"])


def predict(docs: DataFrame, model: Filter | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, and the language and score under ``names``."""
    others = [c for c in keep if c != "text"]
    types = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    shared, first = sent(docs.sparkSession, model), 0 if "text" in keep else 1
    out = docs.select("text", *[F.col(c).alias(f"k{i}") for i, c in enumerate(others)]).mapInArrow(
        lambda b: _predict(b, shared(), first), f"{'' if first else 'text string, '}{types}lang_pred string, score double"
    )
    kept = [F.col("text") if c == "text" else F.col(f"k{others.index(c)}").alias(c) for c in keep]
    return out.select(*kept, F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def accept(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose language is told with at least ``min_score``."""
    found = predict(docs, train(docs), tuple(docs.columns), ("__lang", "__score"))
    return found.where(F.col("__lang") != "und").where(F.col("__score") >= min_score).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.expr(held_out_sql).alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op6_language_id": op6_language_id}
