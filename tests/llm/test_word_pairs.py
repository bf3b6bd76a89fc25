"""The quality classifier's word pairs against a plain Python version."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import kn_pairs, kn_quality
from caseloom.llm.common import staged


SF = "/root/testdata/sf0.1"


def corpus(n=60):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(40)]
    follow = {w: r.sample(words, 3) for w in words}
    out = []
    for _ in range(n):
        text = [r.choice(words)]
        while len(text) < 80:
            text.append(r.choice(follow[text[-1]]))
        out.append(text)
    return out, r


def test_word_order_is_scored(spark):
    texts, r = corpus()
    shuffled = [r.sample(t, len(t)) for t in texts[:5]]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts + shuffled)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x for x in kn_quality.classify(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(len(texts))) and not any(got[len(texts) + i]["kept"] for i in range(5))


def test_pairs_match_plain_python(spark):
    texts, r = corpus(12)
    new = [["zzz", *texts[0][:20]], [], r.sample(texts[1], 40), texts[2]]
    train = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").repartition(3)
    spelling = kn_quality.Spelling(*kn_quality.train(train), shard_rows=100)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(new)], "doc_id long, text string").repartition(2)
    docs = docs.unionAll(docs.filter("doc_id = 3"))
    got = kn_quality.score(docs, staged(kn_quality.word_counts(train, spelling), "pairs"), spelling).collect()
    assert sorted(x["doc_id"] for x in got) == [0, 1, 2, 3, 3]
    c = Counter(p for t in texts for p in zip([None, *t], t))
    d = kn_quality.discounts_of([float(sum(x == i for x in c.values())) for i in (1, 2, 3, 4)])
    total, held = defaultdict(int), defaultdict(float)
    for (v, _), x in c.items():
        total[v] += x
        held[v] += d[min(x, 3) - 1]
    for x in got:
        t, logp = new[x["doc_id"]], 0.0
        for v, w in zip([None, *t], t):
            q = math.exp(spelling(pa.array([w]))[0])
            logp += math.log(max(0, c[v, w] - d[min(c[v, w], 3) - 1]) / total[v] * (c[v, w] > 0) + held[v] / total[v] * q if v in total else q)
        n = sum(len(w) + 1 for w in t)
        assert x["n"] == n and (x["perplexity"] is None if not n else abs(x["perplexity"] / math.exp(-logp / n) - 1) < 1e-5)


def test_short_texts_and_small_languages_are_judged(spark):
    texts, r = corpus(400)
    texts = [t[: (6, 12, 80)[i % 3]] for i, t in enumerate(texts)]
    rows = [(i, " ".join(t), "en" if i % 9 else "de") for i, t in enumerate(texts)] + [(1000, "%%% ### $$$ |||", "en"), (1001, "X9@@q", "de")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x for x in kn_quality.classify(docs, labels).collect()}
    assert not got[1000]["kept"] and not got[1001]["kept"]
    assert sum(got[i]["kept"] for i in range(len(texts))) >= 0.95 * len(texts)  # the threshold is from about 40 documents, so 1 in 40 is to be expected
    short, long = ([got[i]["threshold"] for i in range(len(texts)) if i % 9 and i % 3 == k] for k in (0, 2))
    assert min(short) > max(long)
    few = kn_quality.classify(docs, labels, least_docs=10**9).filter("doc_id in (1, 3, 9)").collect()
    much = kn_quality.classify(docs, labels, least_docs=0).filter("doc_id = 9").first()["threshold"]
    assert got[9]["threshold"] != much and got[9]["threshold"] != next(x["threshold"] for x in few if x["doc_id"] == 9)


def test_frequent_words_change_nothing_but_the_coding(spark):
    """The same scores with no short ids, with some and with all of the words, with one part or many, and with no, some or all pairs in the broadcast table."""
    texts, r = corpus(30)
    new = [["zzz", *texts[0][:20]], r.sample(texts[1], 40), texts[2], ["q" * 100, *texts[3]], []]
    train = spark.createDataFrame([(" ".join(t),) for t in texts + new[3:4]], "text string").repartition(3)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(new)], "doc_id long, text string").repartition(2)
    spelling = kn_quality.Spelling(*kn_quality.train(train))
    found = []
    for words in (0, 7, 1000):
        if words:
            given = kn_pairs.frequent_words(train, words, 1)
            assert len(given) == min(words, len({w for t in texts for w in t}))  # too long a word is not frequent
            spelling.frequent = kn_pairs.Frequent(spark, given, kn_quality.word_keys(pa.array(given)), spelling(pa.array(given)))
        for bits in (1, 5):
            counts = staged(kn_quality.word_counts(train, spelling, bits), "pairs")
            for most in (0, 20, 1 << 20)[: 1 + 2 * (words == 1000)]:
                found.append({x["doc_id"]: x["perplexity"] for x in kn_quality.score(docs, counts, spelling, bits, most).collect()})
    for other in found[1:]:
        assert {i: p and round(math.log(p), 5) for i, p in other.items()} == {i: p and round(math.log(p), 5) for i, p in found[0].items()}


def test_hot_pairs_are_the_most_frequent(spark):
    texts, _ = corpus(20)
    train = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").repartition(3)
    spelling = kn_quality.Spelling(*kn_quality.train(train))
    given = kn_pairs.frequent_words(train, 1000, 1)
    spelling.frequent = kn_pairs.Frequent(spark, given, kn_quality.word_keys(pa.array(given)), spelling(pa.array(given)))
    counts = staged(kn_quality.word_counts(train, spelling, 3), "pairs")
    c = sorted(Counter(p for t in texts for p in zip([None, *t], t)).values(), reverse=True)
    for most in (0, 1, 30, 10_000):
        keys, n = kn_pairs.hot_pairs(counts, most)
        least = min((x for x in set(c) if sum(y >= x for y in c) <= most), default=None)
        assert sorted(n.tolist(), reverse=True) == [x for x in c if least and x >= least] and (np.diff(keys.astype(np.int64)) > 0).all()
    x = np.random.default_rng(1).integers(0, 1 << 32, 1000).astype(np.uint32)
    assert np.array_equal(kn_pairs.unscrambled(kn_pairs.scrambled(x)), x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rejection_rate_of_held_back_documents(spark):
    """Of labelled documents that nothing was learned from, most bad ones go and the good ones stay."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    d = kn_quality.classify(docs, labels).join(labels, "doc_id").filter(kn_quality.held_back(F.col("doc_id")))
    n = {(r["quality"], r["toxic"], r["kept"]): r["count"] for r in d.groupBy("quality", "toxic", "kept").count().collect()}
    rate = lambda q, t: n.get((q, t, False), 0) / (n.get((q, t, False), 0) + n.get((q, t, True), 0))
    assert rate(0, 0) > 0.7 and rate(1, 0) < 0.01, n


def test_arrays_survive_packing():
    kinds = (np.uint32, np.uint16, np.uint64, np.float32)
    for n in (0, 1, 1000):
        arrays = [np.random.default_rng(n).integers(0, 60_000, n).astype(k) for k in kinds]
        for a, b in zip(arrays, kn_pairs.unpacked(kn_pairs.packed(*arrays), *kinds)):
            assert a.dtype == b.dtype and np.array_equal(a, b)
