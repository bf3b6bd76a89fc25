"""Every operator on hostile rows: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.llm import bpe, decontaminate, kn_quality, langid, license_scan, line_dedup, quality_rules, simhash, suffix_dedup
from tests.llm import brute

random.seed(3)
WORDS = "the of and night river stone walk light der und nicht wasser haus el la agua casa noche".split()
CLASH = "words gram pos items gone text_key n label a b c fp low root bucket start raw one spans lines kept trusted id ids perplexity".split()


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "x", "y", "zz"]) for _ in range(n))


BASE = prose(120)
LONG = "\n".join(prose(40) for _ in range(3000))
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.replace("river", "rivers", 1), 3: None, 4: "", 5: "one", 6: "É é ÀÉ\tword\x0bword\x1cword wide " * 30, 7: LONG, 8: "common line\n" + prose(30) + "\n  COMMON line ", 9: "   \n\t\n",
    10: "Licensed under the Apache License, Version 2.0. GNU General Public License; CC-BY cc by MIT License.", 11: "mit mit license license", 12: "a b c d e f g h i j k l m n " + BASE[:300], 13: "🙂" * 200, 14: "<|endoftext|> a<|startoftext|>b It's 42% ́ é",
}
for _i in range(15, 26):
    TEXTS[_i] = "common line\n" + prose(60)


def _rows():
    out = [(i, t, None if i % 5 == 4 else "en", "s", len(t or "")) for i, t in TEXTS.items()]
    return out + [out[0], out[3], (None, prose(50), "de", None, None)]


ROWS = _rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def count_of(df):
    return df.count()


N = len(TEXTS) + 3


def test_line_dedup(docs, empty):
    found = line_dedup.line_dedup(docs, 10).collect()
    assert len(found) == N
    texts = {(r[0], r[1]) for r in rows()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.UP)
    seen = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")})
    for r in found:
        if r["doc_id"] is not None:
            lines = (TEXTS[r["doc_id"]] or "").split("\n")
            kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
            assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept)), r["doc_id"]
    assert line_dedup.line_dedup(empty).count() == 0
    out = line_dedup.rewrite(docs, 10)
    assert out.columns == docs.columns and out.count() == N


def test_suffix_dedup(docs, empty):
    found = suffix_dedup.suffix_dedup(docs, 400).collect()
    assert len(found) == N
    want = brute.repeats([(i, t) for i, t in TEXTS.items()] + [(None, next(r[1] for r in rows() if r[0] is None))])
    for r in found:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) == want[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in (0, 2, 7, 12, *range(15, 26))] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    d = kn_quality.classify(docs, labels, least_docs=1)
    got = d.collect()
    assert len(got) == N and all(r["kept"] for r in got if not (r["doc_id"] is not None and (TEXTS[r["doc_id"]] or "").strip()) and r["doc_id"] is not None)
    split = {(r["doc_id"], r["text_key"]): r["perplexity"] for r in kn_quality.classify(docs, labels, least_docs=1, shard_rows=50, broadcast_ids=0).collect()}
    for r in got:
        other = split[r["doc_id"], r["text_key"]]
        assert (r["perplexity"] is None) == (other is None) and abs((r["perplexity"] or 0) - (other or 0)) <= 1e-6 * (other or 1), r["doc_id"]
    p = {r["doc_id"]: r["perplexity"] for r in got}
    assert p[13] > 5 * p[15] and p[3] is None and p[4] is None and p[9] is None
    assert kn_quality.classify(empty, labels).count() == 0
    assert kn_quality.classify(docs, labels.limit(0)).filter("kept").count() == N
    assert kn_quality.keep_good(docs, labels).columns == docs.columns


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("aab ab ba abba b a ab ab ab",), ("bb ab aa ba",)], "text string")
    model, unknown = kn_quality.train(texts, order=3)
    p = {r["gram"]: 2.718281828459045 ** r["value"] for r in model.filter("kind = 'p'").collect()}
    b = {r["gram"]: 2.718281828459045 ** r["value"] for r in model.filter("kind = 'b'").collect()}
    symbols = [g for g in p if len(g) == 1]

    def prob(context, x):
        if context + x in p:
            return p[context + x]
        if not context:
            return 2.718281828459045**unknown
        return b.get(context, 1.0) * prob(context[1:], x)

    assert abs(sum(p[x] for x in symbols) + 2.718281828459045**unknown - 1) < 1e-9
    for context in {g[:-1] for g in p if len(g) > 1}:
        total = sum(prob(context, x) for x in symbols)
        missing = b[context] * (b[context[1:]] if len(context) > 1 else 1.0) * 2.718281828459045**unknown
        assert abs(total + missing - 1) < 1e-9, context


def test_license_scan(docs, empty):
    found = license_scan.license_scan(docs).collect()
    assert len(found) == N
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"])) == brute.license_base(TEXTS[r["doc_id"]]), r["doc_id"]
            assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert "apache-2.0" in next(r for r in found if r["doc_id"] == 10)["labels"]
    assert license_scan.license_scan(empty).count() == 0


def test_license_passage_survives_an_inserted_word(spark):
    words = dict(license_scan.PASSAGES)["mit-text"].split()
    text = " ".join(["intro"] * 9 + words[:10] + ["really"] + words[10:])
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == ["mit-text"] and r["spans"][0]["start"] == 9 and r["spans"][0]["end"] == 9 + len(words) + 1


def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == N
    null = next(r[1] for r in rows() if r[0] is None)
    want = brute.near_duplicates([(i, t) for i, t in TEXTS.items()])
    for r in found:
        if r["doc_id"] is not None:
            assert (format(r["fp"] % 2**64, "016x"), r["component_id"]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["fp"] % 2**64 == brute.simhash(null)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})


def test_bpe(docs, empty):
    from hashlib import sha256

    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    found = bpe.digests(docs).collect()
    assert len(found) == N
    odd = [" 'S's 'ta b　cᅠ﻿", "İ İ ΣΣ ẞ", "ǻ 한한", "\x00\x1c\x85 x y"]
    texts = {**TEXTS, **{100 + i: x for i, x in enumerate(odd)}}
    found += bpe.digests(docs.sparkSession.createDataFrame([(100 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")).collect()
    for r in found:
        if r["doc_id"] is not None:
            ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t.decode(ids, skip_special_tokens=False))), r["doc_id"]
    assert bpe.digests(empty).count() == 0
    back = bpe.decode(bpe.encode(docs)).filter("doc_id = 14").first()
    assert back["decoded"] == t.decode(list(back["ids"]), skip_special_tokens=False)


def test_language_id(docs, empty):
    dicts = langid.dictionaries(docs.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()))
    found = langid.identify(docs, dicts).collect()
    assert len(found) == N and {r["lang_pred"] for r in found} <= {"en", "de", "und"} and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {3, 4, 9, 13}
    assert langid.identify(docs, {}).filter("lang_pred = 'und'").count() == N
    assert langid.identify(empty, dicts).count() == 0 and langid.dictionaries(empty) == {}
    assert {r["x"] for r in docs.filter("doc_id is not null").select(F.col("doc_id"), langid.held_out(F.col("doc_id")).alias("x")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2} == {True}


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [(1, "River, STONE walk"), (2, "a b c d e f g h i j k"), (3, None), (4, "--"), (5, "b c d e f g h i j k l"), (6, BASE), (6, BASE)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(0))
    windows = [(i, w[k : k + n]) for i, t in set(items) if t for w in [brute.PLAIN.findall(t.translate(brute.UP))] if w for n in [min(10, len(w))] for k in range(len(w) - n + 1)]

    def want(text):
        w = brute.PLAIN.findall((text or "").translate(brute.UP))
        at = [(i, k, len(g)) for i, g in windows for k in range(len(w) - len(g) + 1) if w[k : k + len(g)] == g]
        return len(w), len({x for _, k, n in at for x in range(k, k + n)}), sorted({str(i) for i, _, _ in at})

    for kw in ({}, {"broadcast_rows": 0}, {"leads": 2}):
        monkeypatch.setattr(decontaminate, "LEADS", kw.pop("leads", 20_000))
        found = decontaminate.contamination(docs, bench, **kw).collect()
        assert len(found) == N
        for r in found:
            if r["doc_id"] not in (None, 7):
                assert (r["n_words"], r["n_hit"], list(r["items"])) == want(TEXTS[r["doc_id"]]), r["doc_id"]
    names = decontaminate.contamination(docs, bench.withColumn("item_id", F.concat(F.lit("item-"), F.col("item_id"))))
    assert {(r["doc_id"], *r["items"]) for r in names.collect()} == {(r["doc_id"], *sorted(f"item-{i}" for i in r["items"])) for r in found}
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and not {0, 1, 12} & {r["doc_id"] for r in clean.collect()}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_quality_rules(docs, empty):
    found = quality_rules.quality_rules(docs).collect()
    assert len(found) == N
    for r in found:
        if r["doc_id"] is not None:
            t = TEXTS[r["doc_id"]] or ""
            w = brute.SPACED.findall(t)
            grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
            lines = [x for x in t.split("\n") if brute.SPACED.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)), r["doc_id"]
            assert r["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty).count() == 0
