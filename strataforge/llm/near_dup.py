"""op9: near-duplicate documents by ProbMinHash, banding and verification.

Shingles are runs of five words (a shorter text is one shingle), weighted by how
often they occur. Every shingle is a Poisson process whose rate is its weight:
its arrivals, at exponential gaps, each hit a random component of the signature,
and a component keeps the shingle that arrived first. A document stops as soon
as its next arrivals come later than every component's first. Two signatures
agree in a component with the probability Jaccard similarity of the documents.

Signatures are cut into bands; documents that share a band are candidates. They
are verified exactly, from their texts. Equal texts are one node from the start.
A band's members meet its pivot, and links found merge classes, so a group of
copies costs about one comparison each. Members of bands that still hold several
classes, such as texts with a passage in common, go through an exact filter:
similar texts share one of their rarest shingles, so these become their buckets.
There each class sends pivots that meet the members of other classes, until every
pair is compared, in one class, or told to be different by exact bounds: by the rare shingles
that only one has, and by parity bits of all shingles. So no candidate link is lost,
and members of one class never meet.

Defined results: texts without words (null, empty) are each a class of their own;
``class_id`` is the least doc_id of the class, null if none has an id; repeated
rows and equal texts share a class; words are lower-cased and split at ASCII
characters that are neither letters nor digits; very long texts are taken whole;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, discard, materialize, table, text_key, tidy

#: 56 bands of 8 components: a pair at 0.8 is missed three times in a hundred thousand.
BANDS, ROWS = 56, 8
SIZE = BANDS * ROWS
#: Words handled at once in a task.
CHUNK = 1 << 18
#: Rarest shingles that travel with a row, to tell where a pair meets first.
HEAD = 24
#: 64-bit words of a text's parity bits, a power of two.
PARITY_WORDS = 16
#: Pivots of a bucket in the first round.
FIRST_PIVOTS = 4
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), by document and shingle; starts: the documents' first words, and the end."""
    n, size = np.diff(starts), SHINGLE_WORDS
    doc = np.repeat(np.arange(len(n)), n)
    h, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            h = mix(h * _A + words[i : len(words) - size + 1 + i])
        inside = doc[: len(h)] == doc[size - 1 :]
        h, owner = h[inside], doc[: len(h)][inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        one = []
        for d in short:
            x = np.array([n[d]], np.uint64)
            for w in words[starts[d] : starts[d + 1]]:
                x = mix(x * _A + w)
            one.append(x[0])
        h, owner = np.concatenate([h, np.array(one, np.uint64)]), np.concatenate([owner, short])
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.empty(0, np.int64)
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash of documents: per component the shingle that arrived first; zeros without shingles."""
    first = np.full(n_docs * size, np.inf)
    winner = np.zeros(n_docs * size, np.uint64)
    latest = np.full(n_docs, np.inf)
    # A lone shingle is first everywhere.
    count = np.bincount(doc, minlength=n_docs)
    lone = count[doc] == 1
    winner.reshape(n_docs, size)[doc[lone]] = shingle[lone, None]
    doc, shingle, rate = doc[~lone], shingle[~lone], weight[~lone].astype(float)
    at, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        draw = mix(shingle + np.uint64(step * int(_A) % (1 << 64)))
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        # Early termination: arrivals only get later.
        alive = at < latest[doc]
        if not alive.all():
            doc, shingle, rate, at = doc[alive], shingle[alive], rate[alive], at[alive]
        part = ((mix(shingle * _B + np.uint64(step)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        slot = doc * size + part
        np.minimum.at(first, slot, at)
        won = at == first[slot]
        winner[slot[won]] = shingle[won]
        open_docs = doc[np.concatenate([[True], doc[1:] != doc[:-1]])] if len(doc) else doc
        latest[open_docs] = first.reshape(n_docs, size)[open_docs].max(axis=1)
    return winner.reshape(n_docs, size)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for i in range(ROWS):
        h = mix(h * _A + parts[:, :, i])
    return h


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted (shingle, count) pairs: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    by = np.argsort(x / y, kind="stable")
    x, y = x[by], y[by]
    # With x_j / y_j in order, the larger term is y's before i and x's from i on.
    from_here, before = np.cumsum(x[::-1])[::-1] + only_x, np.cumsum(y) - y + only_y
    return float((1 / (from_here / x + before / y)).sum())


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(lists.offsets, np.int64)
    values = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(np.uint64)
    return values, offsets - offsets[0]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key -> bands, for texts with words."""
    for batch in batches:
        words, offsets = _flat(batch.column(1))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, side="right")) - 1)
            starts = offsets[begin : end + 1]
            doc, shingle, count = shingles(words[starts[0] : starts[-1]], starts - starts[0])
            signature = signatures(doc, shingle, count, end - begin)
            some = np.flatnonzero(np.diff(starts) > 0)
            bands = pa.array(band_hashes(signature)[some].view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), bands)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin).take(pa.array(some)), lists], ["key", "bands"])
            begin = end


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, words) to how many shingles the text has, its distinct ones in order, and, if any repeats, how often each occurs.

    ``parity`` has for each of a number of bits whether an odd number of the shingles falls on it.
    """
    for batch in batches:
        words, offsets = _flat(batch.column(1))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, side="right")) - 1)
            starts = offsets[begin : end + 1]
            doc, shingle, count = shingles(words[starts[0] : starts[-1]], starts - starts[0])
            bounds = pa.array(np.searchsorted(doc, np.arange(end - begin + 1)).astype(np.int32))
            total = np.bincount(doc, count, end - begin).astype(np.int64)
            # Counts are left out where all are one.
            repeats = (total > np.bincount(doc, minlength=end - begin))[doc]
            kept = pa.array(np.searchsorted(doc[repeats], np.arange(end - begin + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(shingle.view(np.int64))), pa.ListArray.from_arrays(kept, pa.array(count[repeats].astype(np.int32)))]
            parity = np.zeros((end - begin, PARITY_WORDS), np.uint64)
            bit = mix(shingle) >> np.uint64(64 - PARITY_WORDS.bit_length() - 5)
            np.bitwise_xor.at(parity, (doc, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            width = pa.array(np.arange(end - begin + 1, dtype=np.int32) * PARITY_WORDS)
            lists.append(pa.ListArray.from_arrays(width, pa.array(parity.view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(total), *lists], ["node", "total", "shingles", "counts", "parity"])
            begin = end


def shingles_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, total, shingles, counts, parity of the texts of nodes (node, key), each text once."""
    keyed = docs.where("text IS NOT NULL").select(text_key(F.col("text")).alias("key"), "text")
    # Tasks keep one copy of a text before they send it on.
    one = keyed.join(nodes, "key").groupBy("node").agg(F.first("text").alias("text"))
    return one.select("node", word_hashes(F.col("text")).alias("words")).mapInArrow(_shingle, "node long, total long, shingles array<long>, counts array<int>, parity array<long>")


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows (la, lb, shingles and counts of both) the links (x, y) between classes, both ways."""
    for batch in batches:
        sides = [(np.asarray(c.values).view(np.uint64) if i % 2 == 0 else np.asarray(c.values), np.asarray(c.offsets)) for i, c in enumerate(batch.columns[2:])]
        similar = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, nx, y, ny = (values[at[i] : at[i + 1]] for values, at in sides)
            nx, ny = (n if len(n) else np.ones(len(s), np.int64) for s, n in ((x, nx), (y, ny)))
            similar[i] = probability_jaccard((x, nx), (y, ny)) >= threshold
        a, b = (np.asarray(batch.column(i))[similar] for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))], ["x", "y"])


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (x, y) between the classes of pairs (a, b, la, lb) whose texts (node, shingles, counts) are similar.

    Both texts stand in a pair's row before it is compared, so a node with many partners is
    spread by the join and needs no task of its own.
    """
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("counts").alias("nx")), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("counts").alias("ny")), "b")
    return pairs.select("la", "lb", "x", "nx", "y", "ny").mapInArrow(lambda rows: _compare(rows, threshold), "x long, y long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(x, root): the least node that links (x, y), given both ways, reach.

    Rounds of least-neighbour roots, each followed by a jump to the root's own root.
    """
    roots = materialize(links.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("root")), "dup-roots")
    while True:
        up = roots.select(F.col("x").alias("r"), F.col("root").alias("up"))
        # A root is a linked node, so each has a root of its own.
        jumped = roots.join(up, roots["root"] == up["r"]).select("x", "up", F.col("root").alias("old"))
        near = links.join(roots.withColumnsRenamed({"x": "y", "root": "n"}), "y").groupBy("x").agg(F.min("n").alias("n"))
        seen = Observation()
        new = jumped.join(near, "x").select("x", F.least("up", "n").alias("root"), "old")
        new = materialize(new.observe(seen, F.count(F.when(F.col("root") != F.col("old"), 1)).alias("moved")).drop("old"), "dup-roots")
        discard(roots)
        roots = new
        if not seen.get["moved"]:
            return roots


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, rank, label) after links (x, y) between labels, which are deleted like the old labels."""
    roots = components(links)
    out = materialize(labels.join(roots.withColumnRenamed("x", "label"), "label", "left").select("node", "rank", F.coalesce("root", "label").alias("label")), "dup-labels")
    discard(links, labels, roots)
    return out


def several(members: DataFrame) -> DataFrame:
    """Of members (bucket, label, ..) those whose bucket holds more than one class."""
    buckets = materialize(members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "dup-several")
    return members.join(buckets, "bucket")


def rare_prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """node, prefix: the rarest shingles (bucket, gap) of each text (node, total, shingles, counts), while the part before them may go unshared.

    If parts s and r of two texts are not shared, their similarity is at most
    1 / (1 + s / (1 - s) + r / (1 - r)). In the order of rarity, all before the first
    common shingle is unshared, so similar texts have a common shingle whose gaps,
    before / (1 - before), add up to at most 1 / threshold - 1. Shingles of a single text are
    unshared from the start: a text with too many has no partner, and most end there.
    """
    each = texts.select("node", "total", F.explode(F.arrays_zip("shingles", "counts")).alias("s"))
    each = each.select("node", F.col("s.shingles").alias("bucket"), (F.coalesce("s.counts", F.lit(1)) / F.col("total")).alias("part"))
    counts = materialize(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "dup-rarity")
    own = Window.partitionBy("node")
    earlier = F.sum("part").over(own.orderBy("n", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    shared = each.join(counts, "bucket").withColumn("before", 1 - F.sum("part").over(own) + F.coalesce(earlier, F.lit(0.0)))
    prefix = shared.where(F.col("before") <= 1 - threshold + 1e-9)
    row = F.struct("n", "bucket", (F.col("before") / (1 - F.col("before"))).alias("gap"))
    prefix = prefix.groupBy("node").agg(F.sort_array(F.collect_list(row)).alias("prefix"))
    return prefix.select("node", F.transform("prefix", lambda x: F.struct(x["bucket"], x["gap"])).alias("prefix"))


def may_be_similar(threshold: float) -> Column:
    """Whether the texts of (total, n, parity) and (total_b, n_b, parity_b) can reach the threshold.

    Each bit that differs stands for at least one shingle that only one of the two has, and the
    numbers of distinct shingles, n and n_b, tell on which sides. So parts s and r at least
    are not shared, and the bound of ``rare_prefixes`` holds: no similar pair is lost.
    """
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i)))) for i in range(PARITY_WORDS)])
    extra = F.col("n") - F.col("n_b")
    s, r = (F.greatest(x, F.lit(0)) / (2.0 * F.col(t)) for x, t in ((differ + extra, "total"), (differ - extra, "total_b")))
    return s * (1 - r) + r * (1 - s) <= (1 / threshold - 1 + 1e-6) * (1 - s) * (1 - r) + 1e-9


def settle(prefixes: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """labels after every pair with a common rare shingle is compared or in one class.

    Buckets have pivots that meet all members of other classes: a few in the first round,
    which merges most, then some of each class. A pivot has then met all others
    and leaves the bucket; what is left goes round again, with the classes as merged and
    sixty-four times the pivots of a class, until no bucket holds two classes. Members of
    one class never meet, so near copies of one text, once merged, cost no more.
    """
    bucket = F.explode(F.transform("prefix", lambda x: F.struct(x["bucket"].alias("bucket"), x["gap"].alias("gap"))))
    rows = prefixes.select("node", F.transform(F.slice("prefix", 1, HEAD), lambda x: x["bucket"]).alias("head"), bucket.alias("p")).select("node", "head", "p.*")
    facts = texts.select("node", "total", F.size("shingles").alias("n"), "parity")
    rows = materialize(several(rows.join(labels, "node")).join(facts, "node"), "dup-members")
    own = ["gap", "head", "total", "n", "parity"]
    pivots_per_class, most = 0, 1 / threshold - 1 + 1e-6
    while not rows.isEmpty():
        by = [F.col("label").alias("class"), F.pmod(F.xxhash64("node"), F.lit(pivots_per_class)).alias("salt")] if pivots_per_class else [F.pmod(F.xxhash64("label"), F.lit(FIRST_PIVOTS)).alias("salt")]
        # By rank, so that a node's buckets agree on their pivots.
        first = F.max(F.struct("rank", "node", "label", *own)).alias("p")
        pivots = rows.groupBy("bucket", *by).agg(first)
        pivots = materialize(pivots.select("bucket", F.col("p.label").alias("lb"), F.col("p.node").alias("b"), *[F.col(f"p.{c}").alias(f"{c}_b") for c in own]), "dup-pivots")
        # A pair meets in the bucket of its rarest common shingle: if the heads have one that is it.
        rarest = F.get(F.array_intersect("head", "head_b"), F.lit(0))
        meet = (F.col("label") != F.col("lb")) & (F.col("gap") + F.col("gap_b") <= most) & F.coalesce(rarest == pivots["bucket"], F.lit(True)) & may_be_similar(threshold)
        met = rows.join(pivots, (rows["bucket"] == pivots["bucket"]) & meet).select(F.col("node").alias("a"), "b", F.col("label").alias("la"), "lb")
        swap = F.col("a") < F.col("b")
        pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
        met = met.select(pick("b", "a").alias("a"), pick("a", "b").alias("b"), pick("lb", "la").alias("la"), pick("la", "lb").alias("lb")).distinct()
        links = materialize(verify(met, texts, threshold), "dup-links")
        linked = not links.isEmpty()
        labels = merge(labels, links) if linked else labels
        left = rows.join(pivots.select("bucket", F.col("b").alias("node")), ["bucket", "node"], "left_anti")
        left = materialize(several(left.drop("label", "rank").join(labels, "node") if linked else left), "dup-members")
        discard(rows, pivots)
        rows, pivots_per_class = left, pivots_per_class * 64 or 64
    discard(rows)
    return labels


@tidy
def node_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """key, label: the class of each distinct text with words."""
    keyed = docs.where("text IS NOT NULL").select(text_key(F.col("text")).alias("key"), word_hashes(F.col("text")).alias("words"))
    signed = keyed.mapInArrow(_sign, "key binary, bands array<long>").groupBy("key").agg(F.first("bands").alias("bands"))
    # Numbers are fixed once written.
    nodes = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")
    each = nodes.select("node", F.explode("bands").alias("bucket"))
    some = materialize(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "dup-buckets")
    # A node's rank is how many in all share its buckets.
    crowd = each.join(some, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("buckets"), F.sum("n").alias("rank"))
    crowd = materialize(crowd, "dup-crowd")
    texts = materialize(shingles_of(docs, nodes.select("node", "key").join(crowd.select("node"), "node")), "dup-texts")
    discard(some)
    # A bucket's pivot is the member with most company, so that the original of many copies comes first.
    members = crowd.select("node", "rank", F.explode("buckets").alias("bucket"))
    pivots = materialize(members.groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("p")).select("bucket", F.col("p.node").alias("b")), "dup-pivots")
    pairs = members.join(pivots, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct().select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
    links = materialize(verify(pairs, texts, threshold), "dup-links")
    labels = merge(crowd.select("node", "rank", F.col("node").alias("label")), links)
    discard(pivots)
    # Candidates that met no common pivot, such as texts that share a passage, are told
    # apart by their rarest shingles, exactly.
    open_nodes = several(members.drop("rank").join(labels, "node")).select("node").distinct()
    rest = materialize(texts.join(open_nodes, "node"), "dup-rest")
    prefixes = materialize(rare_prefixes(rest, threshold), "dup-prefixes")
    labels = settle(prefixes, labels, texts, threshold)
    out = materialize(nodes.select("node", "key").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label")), "dup-classes")
    return out


def order_of(doc_id: Column, text: Column) -> Column:
    """A document's place: its id, or for none a number above all usual ids."""
    spread = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(doc_id.cast("long"), F.lit(1 << 62) + spread)


def _tie(docs: DataFrame) -> Column:
    """Tells rows of one id and text apart by their other columns."""
    plain = [F.col(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, key, ord, tie, class_id, n_class and representative: one row for each document.

    Texts without words have null instead of ``representative``.
    """
    return _near_duplicates(docs, threshold)


@tidy
def _near_duplicates(docs: DataFrame, threshold: float) -> DataFrame:
    classes = node_classes(docs, threshold)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), order_of(F.col("doc_id"), F.col("text")).alias("ord"), _tie(docs).alias("tie"))
    rows = materialize(rows, "dup-rows")
    # Rows, then texts, then classes: each minimum shrinks its input before it is shuffled.
    by_text = rows.groupBy("key").agg(F.min(F.struct("ord", "tie")).alias("m"), F.min("doc_id").alias("d"), F.count("*").alias("n")).join(classes, "key")
    by_text = materialize(by_text, "dup-by-text")
    by_class = by_text.groupBy("label").agg(F.min(F.struct("m.ord", "key", "m.tie")).alias("m"), F.min("d").alias("class_id"), F.sum("n").alias("n_class"))
    of_text = by_text.select("key", "label").join(materialize(by_class, "dup-by-class"), "label").drop("label")
    out = rows.join(materialize(of_text, "dup-of-text"), "key", "left")
    alone = F.col("m").isNull()
    return materialize(out.select(
        "doc_id", "key", "ord", "tie",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"),
        (F.struct("ord", "key", "tie") == F.col("m")).alias("representative"),
    ), "dup-documents")


@tidy
def _kept(docs: DataFrame, threshold: float) -> DataFrame:
    found = _near_duplicates(docs, threshold).where("representative")
    return materialize(found.select(F.col("key").alias("__key"), F.col("ord").alias("__ord"), F.col("tie").alias("__tie")).distinct(), "dup-kept")


def representatives(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns; all texts without words."""
    at = ["__ord", "__key", "__tie"]
    own = docs.withColumns({"__ord": order_of(F.col("doc_id"), F.col("text")), "__key": text_key(F.col("text")), "__tie": _tie(docs)})
    kept = own.join(_kept(docs, threshold), at).dropDuplicates(at).select(*docs.columns)
    return kept.unionByName(docs.where(F.size(word_hashes(F.col("text"))) == 0))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_class", F.coalesce("representative", F.lit(True)).alias("is_representative"))


SQL: dict[str, str] = {}
QUERIES = {"op9_near_dup": op9_near_dup}
