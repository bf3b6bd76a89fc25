"""Language identification against a plain loop over compressors, and its accuracy on the held-out fold."""

import os

import pytest
import zstandard as z
from pyspark.sql import functions as F

from caseloom.llm import langid, queries

SF = "/root/testdata/sf0.01"


def sizes(text, dicts):
    out = {}
    for name, raw in dicts.items():
        coder = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        out[name] = len(coder.compress(langid.letters(text)))
    return out


def test_smallest_result_wins_and_narrow_margins_are_rejected(spark):
    en, de = "the river and the stone of the night ", "der fluss und der stein in der nacht "
    rows = [(i, "en", en * (i + 2)) for i in range(20)] + [(i, "de", de * i) for i in range(20, 30)]
    train = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, id string")
    dicts = langid.dictionaries(train, sample_docs=5, dict_bytes=4096)
    assert list(dicts) == ["en", "de"]
    # Whole texts only: every dictionary is a run of whole training texts.
    texts = {lang: {langid.letters(t) for _, x, t in rows if x == lang} for lang in dicts}
    for lang, raw in dicts.items():
        assert 0 < len(raw) <= 4096 and any(raw.startswith(t.strip()) for t in texts[lang])
    asked = [(1, en * 3), (2, de * 3), (3, "xq zw"), (4, None), (5, "42 !?"), (6, "the fluss"), (None, de), (8, "")]
    got = langid.identify(spark.createDataFrame(asked, "doc_id long, text string").repartition(2), dicts, margin=0.05).collect()
    assert len(got) == len(asked)
    for r in got:
        text = dict(asked)[r["doc_id"]]
        if r["doc_id"] in (4, 5, 8):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        s = sizes(text, dicts)
        best, second = sorted(s.values())
        assert r["lang_pred"] == min(s, key=lambda k: (s[k], list(dicts).index(k)))
        assert abs(r["score"] - (second - best) / second) < 1e-12 and r["rejected"] == ((second - best) / second < 0.05)


def test_ties_go_to_the_language_with_most_rows(spark):
    train = spark.createDataFrame([(1, "b", "same words here"), (2, "b", "same words here"), (3, "a", "same words here")], "doc_id long, lang string, text string")
    dicts = langid.dictionaries(train, sample_docs=1)
    got = langid.identify(spark.createDataFrame([(9, "same words")], "doc_id long, text string"), dicts).first()
    assert (got["lang_pred"], got["score"], got["rejected"]) == ("b", 0.0, True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    got = queries.QUERIES["op8_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    n, right = got.filter("held_out").join(docs, "doc_id").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.98 * n


def test_a_language_of_long_texts_only_is_learned(spark):
    """Texts beyond a quarter of the dictionary give a run of their words from somewhere inside, and no cut words."""
    words = {"en": "river stone night walk light house water".split(), "xx": "zaqor vuplit jemmo kridda wysh ulfo".split()}
    long = lambda lang, k: " ".join(words[lang][(i * i + k) % len(words[lang])] for i in range(9000))
    rows = [(i, "en", " ".join(words["en"][(i + j) % 7] for j in range(40))) for i in range(30)] + [(i, "xx", long("xx", i)) for i in range(30, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    dicts = langid.dictionaries(docs.filter(~langid.held_out(F.col("doc_id"))))
    assert set(dicts) == {"en", "xx"} and all(0 < len(x) <= langid.DICT_BYTES for x in dicts.values())
    assert set(dicts["xx"].decode().split()) == set(words["xx"])
    assert len(dicts["xx"]) > langid.DICT_BYTES // 2
    got = langid.identify(docs, dicts).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 30 else "xx") for r in got)
    one = spark.createDataFrame([(1, "en", "é" * 300_000)], "doc_id long, lang string, text string")
    assert len(langid.dictionaries(one)["en"]) <= langid.DICT_BYTES
