"""op5: benchmark decontamination by a prefix-filtered set join.

A window (ten consecutive item words, or a whole shorter item) must occur in a
document word for word, so its containment threshold is one, and the necessary
prefix of its shingles, ordered by rarity, is its single rarest shingle. The
join therefore looks up document shingles among those anchors only; the
anchor's offset gives where the window would begin, a bound check against the
document's ends (position and length filter) discards what can't fit, and the
words are then compared one by one. Rarity is counted over all documents.

The documents are never shuffled: the benchmark's index goes to them in blocks of
at most ``BLOCK_WORDS`` item words, the size bound of each broadcast and of what
the driver holds; of an item longer than that each block gets a part, and parts overlap
by a window less one word. One block is the usual case and judges documents in
one pass; of a larger benchmark each block marks words and items, and the marks of all
meet by text.

Defined results: null and empty texts have no words, so no hits; a null item text
has no windows, and a null ``item_id`` marks words but is not listed; rows that
share an ``item_id`` count as one item; repeated documents are each judged; an
empty benchmark leaves all documents clean. Words are bytes of digits, letters
lower-cased from A to Z, and all non-ASCII characters.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, materialize, sent, table, text_key

WINDOW = 10
#: Item words in one broadcast index.
BLOCK_WORDS = 300_000
#: Document words handled at once in a task.
CHUNK_WORDS = 1 << 18

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _mix(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers; equal rows are compared later."""
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Windows of one block of items, and where each may be found."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text))
            n = min(WINDOW, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_length[n][ids[i : i + n]].add(item_id)
        self.groups = []
        for n, windows in sorted(by_length.items()):
            keys = list(windows)
            owners = [sorted(x for x in windows[k] if x is not None) for k in keys]
            self.groups.append((np.array(keys, np.int32).reshape(len(keys), n), owners))
        self.size = {len(m[0]): min(SHINGLE_WORDS, len(m[0])) for m, _ in self.groups}
        #: Distinct shingles by size, as sorted hashes.
        self.shingles = {s: np.unique(np.concatenate([_mix(v) for m, _ in self.groups if self.size[m.shape[1]] == s for v in _views(m, s)])) for s in set(self.size.values())}
        self.anchors: list[tuple] = []

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle; ``counts`` are the documents' by size of shingle."""
        for windows, owners in self.groups:
            s = self.size[windows.shape[1]]
            keys = np.stack([_mix(v) for v in _views(windows, s)], axis=1)
            seen = counts[s][np.searchsorted(self.shingles[s], keys)]
            offset = np.argmin(seen, axis=1)
            key = keys[np.arange(len(keys)), offset]
            by = np.argsort(key, kind="stable")
            unique, first = np.unique(key[by], return_index=True)
            self.anchors.append((s, unique, np.append(first, len(key)), offset[by], windows[by], [owners[i] for i in by]))

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))


def _views(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[:, i : i + size] for i in range(rows.shape[1] - size + 1)]


def _known_runs(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``size`` benchmark words follow each other, and the hash of each such run."""
    if len(ids) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    good = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.flatnonzero(good[size:] - good[:-size] == size)
    return at, _mix(ids[at[:, None] + np.arange(size)])


def _lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are there, and where."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    found = np.flatnonzero(sorted_keys[i] == keys)
    return found, i[found]


def _chunks(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple]:
    """(ids, keys, word counts, word numbers with a gap after each document)."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        first, counts, parts, total = 0, [], [], 0
        for i in range(len(texts)):
            words = words_of(texts[i].as_py() or b"")
            counts.append(len(words))
            parts += [index.number(words), np.array([-1], np.int32)]
            total += len(words)
            if total >= CHUNK_WORDS or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), np.array(counts), np.concatenate(parts)
                first, counts, parts, total = i + 1, [], [], 0


def _count(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    seen = {s: np.zeros(len(keys), np.int64) for s, keys in index.shingles.items()}
    for _, _, ids in _chunks(batches, index):
        for s, keys in index.shingles.items():
            _, which = _lookup(_known_runs(ids, s)[1], keys)
            seen[s] += np.bincount(which, minlength=len(keys))
    for s, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["size", "shingle", "n"])


def _occurrences(ids: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray, list, np.ndarray]]:
    """(window length, beginnings, owners, owner numbers) of the windows that occur."""
    runs: dict[int, tuple] = {}
    for s, keys, first, offset, windows, owners in index.anchors:
        if s not in runs:
            runs[s] = _known_runs(ids, s)
        found, which = _lookup(runs[s][1], keys)
        n = first[which + 1] - first[which]
        for part in np.array_split(np.arange(len(found)), max(1, int(n.sum()) // (1 << 20))):
            if not len(part):
                continue
            m = n[part]
            window = np.repeat(first[which[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            begin = np.repeat(runs[s][0][found[part]], m) - offset[window]
            fits = (begin >= 0) & (begin + windows.shape[1] <= len(ids))
            window, begin = window[fits], begin[fits]
            same = (ids[begin[:, None] + np.arange(windows.shape[1])] == windows[window]).all(axis=1)
            if same.any():
                yield windows.shape[1], begin[same], owners, window[same]


def _spans(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple]:
    """(rows, word counts, document beginnings, hit flags, items by row)."""
    for rows, counts, ids in _chunks(batches, index):
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        edge = np.zeros(len(ids) + 1, np.int32)
        items: dict[int, set] = defaultdict(set)
        for length, begin, owners, window in _occurrences(ids, index):
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
            doc = np.searchsorted(starts, begin, side="right") - 1
            for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                items[d].update(owners[w])
        yield rows, counts, starts, np.cumsum(edge[:-1]) > 0, items


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judge(batches: Iterator[pa.RecordBatch], index: Index, first: int) -> Iterator[pa.RecordBatch]:
    """The columns from ``first`` on and the whole result, if the benchmark is one block."""
    for rows, counts, starts, hit, items in _spans(batches, index):
        n_hit = np.add.reduceat(hit.astype(np.int64), starts[:-1])
        columns = [
            *rows.columns[first:],
            pa.array(counts.astype(np.int64)),
            pa.array(n_hit),
            pa.array([len(items[i]) if i in items else 0 for i in range(len(counts))], pa.int64()),
            pa.array([_digest(items.get(i, set())) for i in range(len(counts))]),
            pa.array(n_hit > 0),
        ]
        yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names[first:], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _mark(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Texts with hits in one block of several: hit word positions and items."""
    for rows, counts, starts, hit, items in _spans(batches, index):
        at = [np.flatnonzero(hit[starts[i] : starts[i] + n]).astype(np.int32) for i, n in enumerate(counts)]
        some = [i for i in range(len(counts)) if len(at[i])]
        if some:
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(some)), pa.array([at[i] for i in some], pa.list_(pa.int32())), pa.array([sorted(items.get(i, ())) for i in some], pa.list_(pa.string()))],
                ["key", "at", "items"],
            )


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """Items, or parts of long ones, in blocks of bounded size, each read once."""
    block, size = [], 0
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string"), F.col("text").cast("binary")).distinct()
    most = max(WINDOW, block_words)
    for item_id, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        for at in range(0, max(1, len(words) - WINDOW + 1), most - WINDOW + 1):
            part = words[at : at + most]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            if part:
                block.append((item_id, b" ".join(part)))
                size += len(part)
    if block:
        yield block


def _broadcast_index(docs: DataFrame, items: list):
    """The block's index, ordered by the rarity of its shingles in all documents."""
    spark, index = docs.sparkSession, Index(items)
    plain = sent(spark, index)
    rows = docs.select(F.lit(0).alias("row"), "text").mapInArrow(lambda b: _count(b, plain()), "size int, shingle int, n long")
    counts = {s: np.zeros(len(keys), np.int64) for s, keys in index.shingles.items()}
    for size, shingle, n in rows.groupBy("size", "shingle").agg(F.sum("n")).collect() if index.groups else []:
        counts[size][shingle] = n
    index.order(counts)
    return sent(spark, index)


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each document.

    ``prefix`` goes before the names of what is found.
    """
    # Kept columns travel under other names, so none can clash with a result's.
    others = [c for c in keep if c != "text"]
    names = [f"k{i}" for i in range(len(others))]
    renamed = [F.col(c).alias(n) for c, n in zip(others, names, strict=True)]
    found = blocks(benchmark, block_words)
    block, more = next(found, []), next(found, None)
    if more is None:
        index = _broadcast_index(docs, block)
        types = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(others, names, strict=True))
        first = 1 if "text" in keep else 2
        out = docs.select(F.lit(0).alias("row"), "text", *renamed).mapInArrow(lambda b: _judge(b, index(), first), f"{'text string, ' if first == 1 else ''}{types}{RESULT}")
    else:
        out = _merge(docs, renamed, names, chain([block, more], found))
    kept = [F.col("text") if c == "text" else F.col(names[others.index(c)]).alias(c) for c in keep]
    return out.select(*kept, *[F.col(c.split()[0]).alias(prefix + c.split()[0]) for c in RESULT.split(", ")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    return find_contamination(docs, benchmark, tuple(docs.columns), prefix="__").where("NOT __contaminated").select(*docs.columns)


def _merge(docs: DataFrame, renamed: list[Column], names: list[str], found: Iterable[list]) -> DataFrame:
    """Several blocks: each marks the texts it hits; the marks meet at the text's key."""
    marks = None
    for block in found:
        index = _broadcast_index(docs, block)
        part = docs.select(text_key(F.col("text")).alias("key"), "text").mapInArrow(lambda b, i=index: _mark(b, i()), "key binary, at array<int>, items array<string>")
        part = materialize(part.groupBy("key").agg(F.first("at").alias("at"), F.first("items").alias("items")), "leak-block")
        marks = part if marks is None else marks.unionByName(part)
    marks = marks.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = docs.select(*renamed, "text", text_key(F.col("text")).alias("key"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.size("at"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(marks, "key", "left").select(
        *names, "text", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op5_decontaminate": f"""
    WITH b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS words FROM benchmark),
    bw AS (SELECT item_id, words, least({WINDOW}, len(words)) AS n FROM b WHERE len(words) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM bw)),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
    dw AS (SELECT rid, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
           FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(words) >= n)),
    hit AS (SELECT rid, i, n, item_id FROM dw JOIN win USING (n, w)),
    h AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), range({WINDOW}) r(k) WHERE k < n GROUP BY rid),
    it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
           FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)"""
}
QUERIES = {"op5_decontaminate": op5_decontaminate}
