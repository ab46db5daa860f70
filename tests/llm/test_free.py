"""op3, op5, op6, op9 and op10: against brute force and held-out accuracy, on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strataforge.llm import decontaminate, language_id, near_dup, sentence_spans, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None), (None, ""), (None, "a b"), (2, "x " * 60000), (3, "same"), (3, "same"), (4, " \n\t "), (5, "日本語 текст")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


def babble(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ op3


def test_toxicity_on_documents_it_has_not_seen(spark):
    rng = random.Random(1)
    bad = ["scum", "moron", "trash", "clown"]

    def one(toxic):
        words = babble(rng, rng.randrange(30, 300)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    kinds = [i % 8 == 0 for i in range(900)]
    d = docs(spark, [(i, one(k)) for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, i % 5 == 0, k) for i, k in enumerate(kinds[:600])], "doc_id long, poor boolean, toxic boolean").select("doc_id", F.col("poor").cast("int"), F.col("toxic").cast("int"))
    found = toxicity.score(d, toxicity.train(d, labels)).where("doc_id >= 600").collect()
    right = [r["toxic"] == kinds[r["doc_id"]] for r in found]
    assert len(right) == 300 and np.mean(right) > 0.98


def test_chain_feeds_earlier_categories(spark):
    rng = random.Random(2)
    texts = [("bad " if i % 3 == 0 else "ok ") + babble(rng, 10, 20) for i in range(300)]
    d = docs(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, a int, b int")
    chain = toxicity.train(d, labels, ("a", "b"))
    assert [len(x) for x in chain.dense] == [0, 1] and chain.dense[1][0] > 0
    p = chain.predict(["bad", "ok", None])
    assert p[1][0] > 0.5 > p[1][1] and p.shape == (2, 3)


def plain_link(x, dense, y):
    """One link by plain proximal steps on dense arrays: L1 picks words, L2 weighs those picked."""
    def solve(columns, l1, l2, steps):
        z = np.column_stack([columns, np.ones(len(y))])
        w, step = np.zeros(z.shape[1]), 4 / np.linalg.eigvalsh(z.T @ z)[-1]
        soft = np.concatenate([np.full(columns.shape[1] - dense.shape[1], l1), np.zeros(dense.shape[1] + 1)])
        for _ in range(steps):
            g = z.T @ (1 / (1 + np.exp(-z @ w)) - y)
            g[:-1] += l2 * w[:-1]
            w = w - step * g
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * soft)
        return w

    k = x.shape[1]
    picked = np.flatnonzero(solve(np.hstack([x, dense]), toxicity.L1 * np.sqrt(len(y)), 0.0, 20_000)[:k])
    w = solve(np.hstack([x[:, picked], dense]), 0.0, toxicity.WEAK_L2, 20_000)
    words = np.zeros(k)
    words[picked] = w[: len(picked)]
    return words, w[len(picked) : -1], w[-1]


def test_chain_matches_plain_solver():
    rng = np.random.default_rng(5)
    x = (rng.random((90, 4)) < 0.4).astype(float)
    a = (rng.random(90) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    b = (rng.random(90) < 1 / (1 + np.exp(-(2 * x[:, 2] + 2 * a - 2)))).astype(float)
    labels, fold = np.column_stack([a, b]), np.arange(90) % 3
    row, word = np.nonzero(x)
    chain = toxicity.fit_chain([bytes([97 + i]) for i in range(4)], row, word, labels, fold)
    dense, links = np.empty((90, 0)), []
    for k in range(2):
        held = np.zeros(90)
        for f in range(3):
            # what a row's later link learns from comes from a model that hasn't seen the row
            words, d, bias = plain_link(x[fold != f], dense[fold != f], labels[fold != f, k])
            held[fold == f] = x[fold == f] @ words + dense[fold == f] @ d + bias
        links.append(plain_link(x, dense, labels[:, k]))
        dense = np.column_stack([dense, held])
    total = []
    for words, d, bias in links:
        total.append(x @ words + bias + sum(w * t for w, t in zip(d, total, strict=True)))
    got = chain.predict([" ".join(chr(97 + i) for i in np.flatnonzero(r)) for r in x])
    assert np.abs(got - 1 / (1 + np.exp(-np.array(total)))).max() < 0.01


def test_toxicity_of_awkward_tables(spark):
    d = docs(spark, AWKWARD).withColumn("p_toxic", F.lit(1))
    none = spark.createDataFrame([(None, None, None)], "doc_id long, poor int, toxic int")
    assert toxicity.score(d, toxicity.train(d, none)).where("toxic").count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 0)], "doc_id long, poor int, toxic int")
    assert toxicity.score(d, toxicity.train(d, labels)).count() == len(AWKWARD)
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), labels)).collect() == []
    # Repeated rows, and ids that many documents share, are each scored, the same texts alike.
    many = docs(spark, [(3, "same"), (3, "same"), (3, "other words"), (1, "same")])
    p = [(r["doc_id"], r["p_toxic"]) for r in toxicity.score(many, toxicity.train(many, labels, train_rows=2)).where("doc_id = 3 OR doc_id = 1").collect()]
    assert len(p) == 4 and len({x for _, x in p}) <= 2


# ------------------------------------------------------------------ op5


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute_leaks(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = brute_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, ids = brute_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids.update(str(x) for x in own if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_words", [300_000, 40])
def test_leaks_match_brute_force(spark, block_words):
    rng = random.Random(9)
    items = [(i, babble(rng, rng.choice([3, 7, 10, 14, 40, 130]), 30)) for i in range(25)] + [(25, None), (26, ""), (None, babble(rng, 12, 30)), (3, "second text of three ONE two"), (27, "É-é x9")]
    rows = list(AWKWARD)
    for i in range(80):
        words = babble(rng, rng.randrange(0, 120), 30).split()
        if i % 2:
            item = brute_words(rng.choice(items)[1])
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[: rng.randrange(len(item) + 1)]
        rows.append((10 + i, (", " if i % 3 else " ").join(words).upper() if i % 5 else " ".join(words)))
    rows.append((10, rows[-1][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows).withColumn("n_hit", F.lit("clash")).repartition(3)
    got = decontaminate.find_contamination(d, bench, block_words=block_words)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()) == brute_leaks(rows, items)
    assert decontaminate.clean(d, bench).columns == d.columns
    parts = list(decontaminate.blocks(bench, block_words))
    assert (len(parts) > 1) == (block_words == 40)
    assert all(sum(len(t.split()) for _, t in part) <= block_words for part in parts)


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, AWKWARD), none).collect()
    assert len(got) == len(AWKWARD) and not any(r["contaminated"] for r in got)
    assert decontaminate.find_contamination(docs(spark, []), none).collect() == []


# ------------------------------------------------------------------ op6


def test_languages_held_out(spark):
    rng = random.Random(4)
    parts = {"aa": ["thion", "ther", "ing", "wha"], "bb": ["schung", "lich", "der", "keit"], "cc": ["ción", "ado", "los", "mente"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))), lang, "s", 1))
    d = spark.createDataFrame(rows, DOCS)
    found = language_id.predict(d, language_id.train(d), ("doc_id", "lang"))
    found = found.withColumn("held_out", F.expr(language_id.held_out_sql))
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right[1] > 40 and right[0] > 0.95 and 0 <= right[2] <= right[3] <= 1


def test_training_sees_no_held_out_label(spark):
    d = spark.createDataFrame([(i, f"abc{i} word{i} some", "xx", "s", 1) for i in range(40)], DOCS)
    flipped = d.withColumn("lang", F.when(F.expr(language_id.held_out_sql), "yy").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = language_id.train(d), language_id.train(flipped)
    assert a.langs == b.langs == ["xx"] and (a.table == b.table).all()


def test_filter_of_more_than_64_languages():
    langs = [f"l{i:03d}" for i in range(130)]
    grams = np.random.default_rng(0).integers(1, 1 << 62, 1300).astype(np.uint64)
    masks = np.zeros((1300, 3), np.uint64)
    for i in range(1300):
        masks[i, (i % 130) >> 6] |= np.uint64(1) << np.uint64((i % 130) & 63)
    f = language_id.Filter(langs, grams, masks)
    seen, hits = f.hits(grams, np.arange(1300) % 130, 130)
    assert f.decide(seen, hits)[0] == langs


def test_parts_of_a_long_text_count_like_the_whole(monkeypatch):
    rng = random.Random(14)
    texts = pa.array([" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(n)) for n in (1, 3, 40, 200, 0, 7)] + ["x" * 300, None, "12 3", "日本語" * 40])

    def counted():
        every, once = Counter(), []
        for h, o, _ in language_id._pieces(texts):
            every.update(zip(o.tolist(), h.tolist(), strict=True))
        for h, o in language_id._distinct(texts):
            once += zip(o.tolist(), h.tolist(), strict=True)
        return every, Counter(once)

    whole = counted()
    assert set(whole[1].values()) == {1} and set(whole[0]) == set(whole[1])
    for size in (1, 7, 50):
        monkeypatch.setattr(language_id, "CHUNK_CHARS", size)
        assert counted() == whole


def test_corrected_counts_match_exact_sets():
    rng = np.random.default_rng(3)
    grams = rng.integers(1, 1 << 62, 4000).astype(np.uint64)
    langs = rng.integers(1, 8, 4000).astype(np.uint64)
    f = language_id.Filter(["a", "b", "c"], grams, langs[:, None])
    asked = np.concatenate([rng.choice(grams, 3000), rng.integers(1, 1 << 62, 30_000).astype(np.uint64)])
    sets = {int(g): int(m) for g, m in zip(grams, langs, strict=True)}
    exact = [sum(sets.get(int(g), 0) >> i & 1 for g in asked) for i in range(3)]
    seen, hits = f.hits(asked, np.zeros(len(asked), int), 1)
    assert seen[0] == len(asked) and all(h >= e for h, e in zip(hits[0], exact, strict=True))
    corrected = (hits[0] - seen[0] * f.false_positive) / (1 - f.false_positive)
    assert np.abs(corrected / exact - 1).max() < 0.05


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the thing {i % 7} there", "en", "s", 1) for i in range(600)] + [(1000 + i, f"der schuh {i % 7} dort", "de", "s", 1) for i in range(12)]
    model = language_id.train(spark.createDataFrame(rows, DOCS), train_docs=40)
    assert model.langs == ["de", "en"]
    found = language_id.predict(spark.createDataFrame([(1, "schuh dort", None, None, 1), (2, "thing there", None, None, 1)], DOCS), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {1: "de", 2: "en"}


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    rows = [(i, ("ab cd " if i % 2 else "xy zw ") * 30, "l" if i % 2 else "r", "s", 1) for i in range(60)]
    d = spark.createDataFrame(rows, DOCS)
    model = language_id.train(d)
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 50)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(d, model).collect()}
    assert got == {i: "l" if i % 2 else "r" for i in range(60)}


def test_languages_of_awkward_tables(spark):
    d = docs(spark, AWKWARD).withColumn("score", F.lit("clash"))
    got = language_id.predict(d, language_id.train(d)).collect()
    assert len(got) == len(AWKWARD) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 4)} == {"und"}
    assert language_id.predict(d, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.accept(docs(spark, [])).collect() == []
    assert language_id.accept(d).columns == d.columns


# ------------------------------------------------------------------ op9


def brute_shingles(t):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_similarity(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def test_probability_jaccard_matches_its_definition():
    rng = random.Random(0)
    for _ in range(50):
        x, y = (Counter(rng.choices(range(12), k=rng.randrange(1, 20))) for _ in range(2))
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (x, y)]
        assert near_dup.probability_jaccard(*arrays) == pytest.approx(brute_similarity(x, y))


def test_signatures_estimate_it():
    x, y = {k: 1 + k % 3 for k in range(1, 61)}, {k: 1 + k % 4 for k in range(21, 81)}
    items = [(d, k, n) for d, c in enumerate((x, y)) for k, n in c.items()]
    doc, shingle, weight = (np.array(v) for v in zip(*items, strict=True))
    sig = near_dup.signatures(doc, near_dup.mix(shingle.astype(np.uint64)), weight, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - brute_similarity(x, y)) < 0.03


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_classes_match_brute_force(spark):
    rng = random.Random(11)
    passage = babble(rng, 60).split()
    rows = [*AWKWARD, (9, "X b!"), (10, "x B")]
    for k in range(12):
        base = babble(rng, rng.randrange(40, 160), 3000).split()
        rows += [(100 * k + 100 + i, " ".join(edited(rng, base, rng.randrange(4)))) for i in range(rng.randrange(1, 9))]
    rows += [(5000 + i, " ".join(passage + babble(rng, rng.randrange(8, 90), 3000).split())) for i in range(60)]
    rows += [(6000 + i, " ".join(edited(rng, passage * 3, i % 9))) for i in range(40)] + [(7000, rows[-1][1])]
    sets = [brute_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and (rows[i][1] == rows[j][1] or brute_similarity(sets[i], sets[j]) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            members[root(i)].append(doc_id)
    want = Counter((doc_id, min(members[root(i)])) for i, (doc_id, _) in enumerate(rows) if doc_id is not None)
    d = docs(spark, rows).withColumn("key", F.lit("clash")).repartition(5)
    found = near_dup.near_duplicates(d)
    assert Counter((r["doc_id"], r["class_id"]) for r in found.where("doc_id IS NOT NULL").collect()) == want
    kept = near_dup.representatives(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for _, c in want})
    assert kept.count() == len({c for _, c in want}) + 2  # the two without an id


def test_parity_bounds_lose_no_similar_pair(spark):
    rng = random.Random(15)
    texts = []
    for _ in range(60):
        base = babble(rng, rng.randrange(1, 200), rng.choice([6, 400])).split()
        texts += [" ".join(base), " ".join(edited(rng, base, rng.randrange(5)))]
    d = docs(spark, list(enumerate(texts)))
    nodes = d.select(F.col("doc_id").alias("node"), near_dup.text_key(F.col("text")).alias("key")).dropDuplicates(["key"])
    facts = near_dup.shingles_of(d, nodes).select("node", "total", F.size("shingles").alias("n"), "parity")
    other = facts.select(*[F.col(c).alias(f"{c}_b") for c in facts.columns])
    kept = {(r[0], r[1]) for r in facts.crossJoin(other).where(near_dup.may_be_similar(0.8)).select("node", "node_b").collect()}
    ids = [r[0] for r in nodes.select("node").collect()]
    similar = {(a, b) for a in ids for b in ids if brute_similarity(brute_shingles(texts[a]), brute_shingles(texts[b])) >= 0.8}
    assert similar <= kept and len(similar) > len(ids) + 20 and len(kept) < len(ids) ** 2 / 4


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []
    assert near_dup.representatives(docs(spark, [(1, None), (2, "")])).count() == 2


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 1000)
    rng = random.Random(17)
    long = babble(rng, 6000, 10**5).split()
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 20))), (3, " ".join(long[::-1])), (4, babble(rng, 30)), (5, None)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_rows_of_one_id_and_text_that_differ_elsewhere(spark):
    d = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]).withColumn("n_chars", F.monotonically_increasing_id())
    d = spark.createDataFrame(d.collect(), d.schema)
    kept = [near_dup.representatives(x).collect() for x in (d.coalesce(1), d.repartition(3), d.orderBy(F.desc("n_chars")))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1 and kept[0][0]["doc_id"] == 1


def test_different_texts_under_one_id_stay(spark):
    rng = random.Random(12)
    texts = [babble(rng, 60) for _ in range(9)]
    near = texts[0] + " more"
    rows = [(7, t) for t in texts] + [(7, near), (7, texts[1]), (8, texts[2]), (9, near), (7, None), (7, "--"), (7, "--")]
    kept = near_dup.representatives(docs(spark, rows).repartition(3)).collect()
    assert {r["doc_id"] for r in kept} == {7}
    assert sum(r["text"] in (texts[0], near) for r in kept) == 1
    assert sorted(r["text"] for r in kept if r["text"] in texts[1:]) == sorted(texts[1:])
    assert Counter(r["text"] for r in kept if r["text"] in (None, "--")) == {None: 1, "--": 2}


# ------------------------------------------------------------------ op10


def brute_removed(rows):
    seen, gone = set(), defaultdict(set)
    for doc_id, t in sorted(rows):
        pieces = sentence_spans.sentences(t)
        words = [re.findall(r"[^ \t\n\r\x0b\x0c]+", p.lower()) for p in pieces]
        for i in range(len(pieces)):
            for n in (1, 2, 3):
                if i + n <= len(pieces):
                    key = tuple(map(tuple, words[i : i + n]))
                    if sum(map(len, key)) >= (8 if n == 3 else 40):
                        if key in seen:
                            gone[doc_id].update(range(i, i + n))
                        seen.add(key)
    return gone


def test_spans_match_brute_force(spark):
    rng = random.Random(6)
    pool = [babble(rng, rng.randrange(1, 9), 50) + rng.choice([". ", "! ", ".\n", "\n", "... "]) for _ in range(25)] + [babble(rng, 45, 50) + ". "]
    rows = [(i, "".join(rng.choices(pool, k=rng.randrange(0, 14)))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n"), (503, " a. "), (504, "v1.2 is out.Now. ok " * 3)]
    d = docs(spark, rows).repartition(4)
    want = brute_removed(rows)
    got = {r["doc_id"]: set(r["removed"]) for r in sentence_spans.repeated_sentences(d).collect()}
    assert got == {i: want.get(i, set()) for i, _ in rows} and sum(map(len, want.values())) > 50
    clean = {r["doc_id"]: r["text"] for r in sentence_spans.remove_repeats(d.withColumn("removed", F.lit(1))).collect()}
    for i, t in rows:
        assert clean[i] == ("".join(p for k, p in enumerate(sentence_spans.sentences(t)) if k not in want[i]) if want.get(i) else t)


def test_texts_that_share_an_id_keep_their_own_sentences(spark):
    rng = random.Random(16)
    say = lambda n: [babble(rng, 12, 10**6) + ". " for _ in range(n)]
    first, own, other, shared = say(4), say(3), say(3), say(3)
    rows = [(1, "".join(first)), (2, "".join(first)), (2, "".join(own)), (2, "".join(own + shared)), (2, "".join(shared + other)), (2, "".join(own)), (None, "".join(first)), (None, "".join(other))]
    # documents in order: by id, then by the hash of their text
    place = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) & ((1 << 62) - 1))
    seen, want = set(), {}
    for r in sorted(set(rows), key=place):
        pieces, gone = sentence_spans.sentences(r[1]), set()
        for i in range(len(pieces) - 2):
            run = tuple(p.strip() for p in pieces[i : i + 3])
            if run in seen:
                gone.update(range(i, i + 3))
            seen.add(run)
        want[r] = "".join(p for k, p in enumerate(pieces) if k not in gone)
    got = Counter((r["doc_id"], r["text"]) for r in sentence_spans.remove_repeats(docs(spark, rows).repartition(4)).collect())
    assert got == Counter((r[0], want[r]) for r in rows)
    assert want[(2, "".join(first))] == "" and sum(s in "".join(t for _, t in got) for s in own + shared + other) == 9


def test_spans_of_long_texts(spark):
    rng = random.Random(18)
    many = [babble(rng, 8, 10**6) + ". " for _ in range(20_000)]
    rows = [(1, "".join(many[:10_000])), (2, "".join(many[9_000:])), (3, None)]
    got = {r["doc_id"]: r["removed"] for r in sentence_spans.repeated_sentences(docs(spark, rows)).collect()}
    assert got == {1: [], 2: list(range(1000)), 3: []}


def test_sentences_join_to_the_text():
    for t in ("A b. C!  D?\n\nE", "  lead. x", "...", "a.b c", "x\n\n\ny. ", "日本。", "end."):
        assert "".join(sentence_spans.sentences(t)) == t


def test_passages_of_one_sentence_and_awkward_tables(spark):
    long = " ".join(f"q{i}" for i in range(55)) + "."
    rows = [(1, "Mine first. " + long + " Own end one."), (2, "Other start. " + long + " Another end."), *[(10 + i, t) for i, (_, t) in enumerate(AWKWARD)], (None, long), (None, long)]
    got = {(r["doc_id"], tuple(r["removed"])) for r in sentence_spans.repeated_sentences(docs(spark, rows)).collect()}
    assert (1, ()) in got and (2, (1,)) in got and (None, (0,)) in got
    assert sentence_spans.repeated_sentences(docs(spark, [])).collect() == []
