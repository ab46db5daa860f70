"""run(): each stage against brute force on the stage's own input."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_free import brute_leaks, brute_shingles, brute_similarity
from test_native import brute_mix

from strataforge.llm import language_id, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "ing", "tion", "and", "wh"], "fr": ["eau", "oux", "ment", "ille", "ou"]}


def written(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(n)]


@pytest.fixture
def corpus(spark, tmp_path):
    """Documents with near copies, leaks, awkward rows and columns that clash with those of the operators."""
    rng = random.Random(8)
    item = " ".join("".join(rng.choices(SYLLABLES["en"], k=3)) for _ in range(15))
    rows = []
    for i in range(150):
        lang = "en" if i % 3 else "fr"
        words = written(rng, lang, 60)
        if i % 20 == 7:
            words[10:10] = item.split()
        rows.append((i, " ".join(words), lang, f"src{i % 4}", 1))
    rows += [(200 + i, rows[i][1] + " thetion", rows[i][2], "src1", 1) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "123 456", "en", "src0", 1), (302, "", "en", None, 1), (None, " ".join(written(rng, "en", 50)), None, "src2", None), (303, " ".join(written(rng, "fr", 9000)), "fr", "src3", 1)]
    rows += [rows[5], rows[5], (5, " ".join(written(rng, "en", 40)), "en", "src1", 1)]
    d = spark.createDataFrame(rows, DOCS)
    clashing = ("score", "lang_pred", "key", "ord", "n_hit", "contaminated", "domain", "n_tokens", "order_key", "epochs", "page", "depth")
    d.withColumns({c: F.lit("mine") for c in clashing}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (None, "some other words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [(1, item), (None, "some other words"), (2, None)]


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_match_brute_force(spark, corpus):
    sf_dir, items = corpus
    inputs, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "shards":
            assert out.columns == docs.columns
            assert out.where("score <> 'mine' OR domain <> 'mine' OR page <> 'mine'").isEmpty()
        out.write.parquet(path := f"{sf_dir}/out-{name}")
        inputs[name], docs = (rows_of(docs), None if name == "shards" else Counter(rows_of(spark.read.parquet(path)))), spark.read.parquet(path)
    # language: what has letters in a learned language stays
    before, kept = inputs["language"]
    assert kept == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))
    # near copies: of each class of texts the row with the least id, then the least text
    before, kept = inputs["near_copies"]
    texts = sorted({t for _, t, _, _ in before})
    sets, parent = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((sets[i].total(), sets[j].total()))
            if root(i) != root(j) and small >= 0.8 * large and len(sets[i] & sets[j]) and brute_similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    classes = {}
    for r in set(before):
        order = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
        classes.setdefault(root(texts.index(r[1])), []).append((order, r))
    assert kept == Counter(min(c)[1] for c in classes.values()) and len(classes) < len(before) - 20
    # leaks: documents without a window of the benchmark stay
    before, kept = inputs["leaks"]
    bad = {x[0] for x in brute_leaks([(i, t) for i, (_, t, _, _) in enumerate(before)], items) if x[5]}
    assert kept == Counter(r for i, r in enumerate(before) if i not in bad) and len(bad) >= 7
    # mixture: half of the words, no document twice
    before, kept = inputs["mixture"]
    taken = brute_mix(spark, before, corpus_pipeline.MAX_EPOCHS)
    assert {k[4] for k in taken} == {1}
    assert Counter(r[0] for r in kept.elements()) == Counter({i: sum(n for k, n in taken.items() if k[0] == i) for i in {k[0] for k in taken}})
    # shards: all there, in one shard, since all fit
    left = Counter((r[0], len(r[1].encode())) for r in inputs["mixture"][1].elements())
    final = docs.collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in final) == left
    assert sum(r["n_bytes"] for r in final) < sharding.SHARD_BYTES and {(r["depth"], r["page"], r["shard_bits"]) for r in final} == {(0, 0, "")}
    assert Counter(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(str, final))


def test_the_language_stage_leaves_clean_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    found = language_id.predict(docs, language_id.train(docs), ("doc_id", "lang"))
    assert found.where("lang IS NOT NULL AND lang_pred <> 'und' AND lang <> lang_pred").isEmpty()


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
