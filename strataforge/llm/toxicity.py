"""op3: toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models on the
presence of words. Each later model also sees the log-odds of all earlier
categories. In training these are out-of-fold predictions, made for each fold by
a model fitted on the others, so that a later model learns from predictions as
good as those it will meet; in use they come from the model fitted on all rows.
An L1 penalty picks the words, a weak L2 refit on the picked words takes its
shrinkage back, so a few strong words count as much in a long text as in a short.
Of labelled rows with the same words and labels one is learned from.

The label table has two properties, so the query's chain has two links: ``poor``
(quality 0) and then ``toxic``. The operator takes any label columns, in the
order of the chain. Training reads a hashed sample of about ``TRAIN_ROWS``
labelled rows, the bound on what the driver gathers, and of their words those in
``MIN_ROWS`` rows or more that pass a chi-squared screen of ``MIN_Z`` standard
deviations for some category. Labels of the sample are few, so they go to the
documents, whose texts are not shuffled. Every document is scored whole.

Defined results: a null or empty text has no words and is scored by the models'
intercepts; rows with a null label are not learned from, nor null ids (they
join no label); several labels of one document are each learned from; repeated
documents are each scored; without labels all probabilities are 0. Other columns
may be carried with ``keep`` under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sent, table

TRAIN_ROWS = 20_000
MIN_ROWS, MIN_Z = 3, 2.5
FOLDS = 3
THRESHOLD = 0.5
#: Weak enough for a word that is always toxic to decide on its own.
WEAK_L2 = 0.05
#: The penalty that picks words, as a part of the root of the number of rows.
L1 = 0.06
CATEGORIES = ("poor", "toxic")
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


class Linear:
    """A sparse logistic model of rows (indptr, indices) and a few dense columns."""

    def __init__(self, n_words: int, n_dense: int):
        self.words, self.dense, self.bias = np.zeros(n_words), np.zeros(n_dense), 0.0

    def logit(self, row: np.ndarray, word: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.words[word], len(dense)) + dense @ self.dense + self.bias

    def fit(self, row: np.ndarray, word: np.ndarray, dense: np.ndarray, y: np.ndarray, l1: float, l2: float, only: np.ndarray | None = None, steps: int = 300) -> Linear:
        """Accelerated proximal gradient from the current weights; ``only`` limits the words."""
        n, k, d = len(y), len(self.words), dense.shape[1]
        w = np.concatenate([self.words, self.dense, [self.bias]])
        free = np.ones(len(w))
        if only is not None:
            free[:k] = only
        penal = np.concatenate([np.full(k, l1), np.zeros(d + 1)])
        # Columns differ widely in how often they occur: scale each step by its curvature's bound.
        per_row = np.bincount(row, minlength=n) + (dense != 0).sum(axis=1) + 1
        curve = np.concatenate([np.bincount(word, per_row[row], k), (dense**2 * per_row[:, None]).sum(axis=0), [per_row.sum()]]) / 4 + l2 + 1e-9
        z, last, t = w.copy(), w.copy(), 1.0
        for _ in range(steps):
            logit = np.bincount(row, z[word], n) + dense @ z[k : k + d] + z[-1]
            r = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
            g = np.concatenate([np.bincount(word, r[row], k), dense.T @ r, [r.sum()]])
            g[:-1] += l2 * z[:-1]
            x = z - free * g / curve
            x = np.sign(x) * np.maximum(0, np.abs(x) - penal / curve)
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z = x + (t - 1) / nt * (x - last)
            if np.abs(x - last).max() < 1e-5:
                last = x
                break
            last, t = x, nt
        self.words, self.dense, self.bias = last[:k], last[k : k + d], float(last[-1])
        return self


def fit_link(row: np.ndarray, word: np.ndarray, dense: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """One model: L1 picks words, a weak L2 refit weighs them."""
    model = Linear(n_words, dense.shape[1]).fit(row, word, dense, y, L1 * np.sqrt(len(y)), 0.0)
    picked = model.words != 0
    model.words[:] = 0
    own = picked[word]
    return model.fit(row[own], word[own], dense, y, 0.0, WEAK_L2, only=picked, steps=600)


class Chain:
    """Models in the order of the categories, on the words that any of them uses."""

    def __init__(self, vocab: list[bytes], links: list[Linear]):
        used = [i for i in range(len(vocab)) if any(m.words[i] for m in links)]
        self.vocab = {vocab[i]: j for j, i in enumerate(used)}
        self.words = np.array([m.words[used] for m in links]).reshape(len(links), len(used))
        self.dense = [m.dense for m in links]
        self.bias = [m.bias for m in links]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row for each category."""
        known, total = self.vocab.keys(), np.zeros((len(self.bias), len(texts)))
        for i, text in enumerate(texts):
            found = [self.vocab[w] for w in known & words_of(text)]
            if found:
                # summed in order of the vocabulary, so that a text's score never depends on chance
                total[:, i] = self.words[:, np.sort(found)].sum(axis=1)
        for k in range(len(self.bias)):
            total[k] += self.bias[k]
            for j, w in enumerate(self.dense[k]):
                total[k] += w * total[j]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_chain(vocab: list[bytes], row: np.ndarray, word: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """Labels and fold have a row for each document; row and word are the documents' words."""
    n, links = len(labels), []
    dense = np.empty((n, 0))
    for k in range(labels.shape[1]):
        y, held = labels[:, k].astype(float), np.zeros(n)
        for f in np.unique(fold):
            out = fold == f
            number = np.cumsum(~out) - 1
            own = ~out[row]
            if out.all():
                continue
            model = fit_link(number[row[own]], word[own], dense[~out], y[~out], len(vocab))
            held[out] = model.logit(row, word, dense)[out]
        links.append(fit_link(row, word, dense, y, len(vocab)))
        dense = np.column_stack([dense, held])
    return Chain(vocab, links)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words, pa.list_(pa.binary()))], [*batch.schema.names[1:], "words"])


def _numbers(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(number[w] for w in row if w in number) for row in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words, pa.list_(pa.int32()))], [*batch.schema.names[1:], "words"])


def _some(rows: DataFrame, share: float, *by: str) -> DataFrame:
    """A share of the rows, chosen by a hash."""
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(share * (1 << 30)))


def labelled_words(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, train_rows: int = TRAIN_ROWS) -> DataFrame | None:
    """The categories and ``words`` (distinct, in order) of about ``train_rows`` labelled documents, those that agree in both once."""
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).where(" AND ".join(f"{c} IS NOT NULL" for c in ("doc_id", *categories))).distinct()
    n = known.count()
    if not n:
        return None
    known = materialize(_some(known, train_rows / n, "doc_id"), "labels")
    rows = docs.select("doc_id", "text")
    # A label row takes some tens of bytes: the sample is small enough to send, but for a sample's chance to be large.
    rows = rows.join(F.broadcast(known) if known.count() <= 2 * train_rows else known, "doc_id").select("text", *categories)
    kinds = ", ".join(f"{c} int" for c in categories)
    rows = materialize(rows.mapInArrow(_word_sets, f"{kinds}, words array<binary>").distinct(), "labelled-words")
    # Ids that many documents share join more rows than there are labels.
    return _some(rows, train_rows / max(1, rows.count()), "words")


def useful_words(rows: DataFrame, categories: tuple[str, ...]) -> list[bytes]:
    """Words that tell some category from the rest, in order."""
    total = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counts = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories])
    share = {c: (total[c] or 0) / max(1, total["n"]) for c in categories}
    screen = [F.abs(F.col(c) - F.col("n") * p) / F.sqrt(F.col("n") * max(1e-9, p * (1 - p))) >= MIN_Z for c, p in share.items()]
    chosen = counts.where(F.col("n") >= MIN_ROWS).where(F.exists(F.array(*screen), lambda x: x)).select("word").collect()
    return sorted(bytes(r[0]) for r in chosen)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, train_rows: int = TRAIN_ROWS) -> Chain | None:
    """``docs``: doc_id, text. ``labels``: doc_id and a 0/1 column for each category."""
    rows = labelled_words(docs, labels, categories, train_rows)
    if rows is None:
        return None
    vocab = useful_words(rows, categories)
    number = sent(docs.sparkSession, {w: i for i, w in enumerate(vocab)})
    kinds = ", ".join(f"{c} int" for c in categories)
    # Only numbers of useful words come to the driver, at most a sample's.
    numbered = rows.select("words", F.pmod(F.xxhash64("words"), F.lit(FOLDS)).cast("int").alias("fold"), *categories).mapInArrow(lambda b: _numbers(b, number()), f"fold int, {kinds}, words array<int>")
    found = [(r["fold"], tuple(r["words"]), *[r[c] for c in categories]) for r in numbered.collect()]
    if not found:
        return None
    found.sort()
    row = np.repeat(np.arange(len(found)), [len(r[1]) for r in found])
    word = np.fromiter((w for r in found for w in r[1]), np.int64, len(row))
    y = np.array([r[2:] for r in found], float).reshape(len(found), len(categories))
    # Rows with the same words are in one fold, so none predicts its own copy.
    fold = np.array([r[0] for r in found])
    return fit_chain(vocab, row, word, y, fold)


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        p = chain.predict([texts[i].as_py() for i in range(len(texts))])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x) for x in p]], [*batch.schema.names[1:], *[f"p{k}" for k in range(len(p))]])


def score(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...] = CATEGORIES, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, p_<category> for each, and a boolean named like the last category."""
    last = categories[-1]
    if chain is None:
        out = docs.select(*keep, *[F.lit(0.0).alias(f"p_{c}") for c in categories])
    else:
        shared = sent(docs.sparkSession, chain)
        names = [f"k{i}" for i in range(len(keep))]
        types = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names, strict=True))
        ps = [f"p{k}" for k in range(len(categories))]
        out = docs.select("text", *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]).mapInArrow(lambda b: _score(b, shared()), types + ", ".join(f"{p} double" for p in ps))
        out = out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[F.col(p).alias(f"p_{c}") for p, c in zip(ps, categories, strict=True)])
    return out.withColumn(last, F.col(f"p_{last}") >= threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    return score(docs, train(docs, labels))


SQL: dict[str, str] = {}
QUERIES = {"op3_toxicity": op3_toxicity}
