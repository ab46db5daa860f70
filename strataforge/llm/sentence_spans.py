"""op10: substring dedup by sliding sentence spans.

Each document is cut into sentences. Every run of ``RUN`` consecutive sentences is
hashed, and every shorter run that already has ``LONG_RUN_WORDS`` words, so that
a passage of one or two long sentences counts as well. Runs meet by hash over
the whole table; of equal runs the first, by document then position, stays, and
the sentences covered by any other are removed.

Runs travel as two 64-bit hashes and a document's place, once for each document.
A run's first document is a minimum, so hot runs shrink before the shuffle, and
only runs of several documents are joined back. A place is the document's id
followed by 62 bits of a hash of its text, in one number, so texts that
differ are documents of their own even where they share an id.

Defined results: sentences end at ``.``, ``!`` or ``?`` before white space, or at line
ends; they are compared lower-cased with white space collapsed; pieces without a
word belong to the sentence before them. Null and empty texts have no sentences.
Rows equal in ``doc_id`` and text count as one document; different texts under one
id are different documents, in the order of a hash of their text, as are texts with a
null id, which come after all others. Runs of fewer than ``MIN_RUN_WORDS`` words are never
removed. Very long texts are taken whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

RUN = 3
#: A run of fewer words is too plain to count as repeated text.
MIN_RUN_WORDS = 8
LONG_RUN_WORDS = 40
_PIECE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![.!? \t\r\x0b\x0c\n])[^.!?\n]*)*(?:[.!?]+[ \t\r\x0b\x0c\n]+|\n+|[.!?]*\Z)")
_WS = re.compile(r"[ \t\n\r\x0b\x0c]+")


def sentences(text: str | None) -> list[str]:
    """Pieces that join to the text, each with a word but for white space at the start."""
    out: list[str] = []
    for m in _PIECE.finditer(text or ""):
        piece = m.group()
        if not piece:
            continue
        if piece.strip(" \t\n\r\x0b\x0c") or not out:
            out.append(piece)
        else:
            out[-1] += piece
    return out if any(x.strip(" \t\n\r\x0b\x0c") for x in out) else []


def runs(pieces: list[str]) -> list[tuple[str, int, int]]:
    """(text, first sentence, sentences) of each run to compare."""
    keys = [" ".join(x for x in _WS.split(p.lower()) if x) for p in pieces]
    words = [k.count(" ") + 1 if k else 0 for k in keys]
    found = []
    for i in range(len(keys)):
        total = 0
        for n in range(1, min(RUN, len(keys) - i) + 1):
            total += words[i + n - 1]
            if total >= (MIN_RUN_WORDS if n == RUN else LONG_RUN_WORDS):
                found.append(("\n".join(keys[i : i + n]), i, n))
    return found


def place_of(doc_id: Column, text: Column) -> Column:
    """Where a document stands: by id, none last, then by its text's hash."""
    own = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    first = F.coalesce(doc_id.cast("long"), F.lit(1 << 62) + own)
    return (first.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + own).cast("decimal(38,0)")


SPANS = "n_sentences int, h1 array<long>, h2 array<long>, at array<int>, n array<int>, again array<int>"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its runs, each once, and the sentences that repeat within it."""
    import xxhash

    for batch in batches:
        text = batch.column(0)
        rows: list[tuple] = []
        for i in range(len(text)):
            pieces = sentences(text[i].as_py())
            seen: dict[bytes, tuple[int, int]] = {}
            again: set[int] = set()
            for key, at, n in runs(pieces):
                h = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
                if h in seen:
                    again.update(range(at, at + n))
                else:
                    seen[h] = (at, n)
            h = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2)
            at, n = np.array(list(seen.values()), np.int32).reshape(-1, 2).T
            rows.append((len(pieces), h[:, 0], h[:, 1], at, n, sorted(again)))
        counts, *lists = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(counts, pa.int32()), *[pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]],
            [*batch.schema.names[1:], "n_sentences", "h1", "h2", "at", "n", "again"],
        )


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, place, n_sentences and the sorted numbers of the sentences to remove."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = docs.select("text", "doc_id", place_of(F.col("doc_id"), F.col("text")).alias("place")).mapInArrow(_hash, f"doc_id {id_type}, place decimal(38,0), {SPANS}")
    spans = materialize(spans, "spans")
    each = spans.select("place", F.explode(F.arrays_zip("h1", "h2", "at", "n")).alias("r")).select("place", "r.*")
    firsts = each.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("h1", "h2", "first")
    firsts = materialize(firsts, "span-firsts")
    later = each.join(firsts, ["h1", "h2"]).where("place <> first").select("place", "at", "n")
    covered = later.groupBy("place").agg(F.collect_set(F.struct("at", "n")).alias("c"))
    covered = covered.select("place", F.flatten(F.transform("c", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))).alias("covered"))
    removed = F.array_sort(F.array_distinct(F.concat("again", F.coalesce("covered", F.array().cast("array<int>")))))
    return spans.select("doc_id", "place", "n_sentences", "again").join(covered, "place", "left").select("doc_id", "place", "n_sentences", removed.alias("removed"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            gone = set(removed or ())
            out.append("".join(p for i, p in enumerate(sentences(text)) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their text cut; other columns as they are."""
    # Rows of one place are equal in text, and so in what is removed.
    marks = repeated_sentences(docs).where(F.size("removed") > 0).select(F.col("place").alias("__place"), F.col("removed").alias("__removed")).dropDuplicates(["__place"])
    names = [c for c in docs.columns if c != "text"]
    with_marks = docs.withColumn("__place", place_of(F.col("doc_id"), F.col("text"))).join(marks, "__place", "left")
    types = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = with_marks.select("text", "__removed", *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)]).mapInArrow(_cut, f"text string{types}")
    return out.select(*["text" if c == "text" else F.col(f"k{names.index(c)}").alias(c) for c in docs.columns])


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_sentences(table(spark, sf_dir, "documents"))
    n = F.size("removed").cast("long")
    return found.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), n.alias("n_removed"), (n > 0).alias("has_repeat"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))


SQL = {
    "op10_sentence_spans": rf"""
    WITH p AS (SELECT row_number() OVER () AS rid, doc_id,
                 list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]+[ \t\r\x0b\x0c\n]+|\n+)', '\1' || chr(1), 'g'), chr(1)),
                             lambda x: regexp_matches(x, '[^ \t\n\r\x0b\x0c]')) AS s FROM documents),
    k AS (SELECT rid, doc_id, len(s) AS n_sentences,
                 list_transform(s, lambda x: array_to_string(regexp_extract_all(lower(x), '[^ \t\n\r\x0b\x0c]+'), ' ')) AS s FROM p),
    r AS (SELECT rid, doc_id, i, n, array_to_string(s[i + 1:i + n], chr(10)) AS key,
                 len(regexp_extract_all(array_to_string(s[i + 1:i + n], ' '), '[^ ]+')) AS words
          FROM (SELECT *, unnest(range(len(s))) AS i FROM k), range(1, {RUN + 1}) t(n) WHERE i + n <= len(s)),
    g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS occurrence FROM r
          WHERE words >= CASE WHEN n = {RUN} THEN {MIN_RUN_WORDS} ELSE {LONG_RUN_WORDS} END),
    gone AS (SELECT DISTINCT rid, i + j AS pos FROM g, range({RUN}) t(j) WHERE occurrence > 1 AND j < n),
    a AS (SELECT rid, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY rid)
    SELECT doc_id, n_sentences::BIGINT AS n_sentences, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n, 0) > 0 AS has_repeat, coalesce(removed, '') AS removed
    FROM k LEFT JOIN a USING (rid)"""
}
QUERIES = {"op10_sentence_spans": op10_sentence_spans}
