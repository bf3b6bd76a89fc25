"""The pipeline against a brute-force version of its stages."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import bpe, kn_quality
from caseloom.llm.common import made
from tests.llm import brute

random.seed(11)
VOCAB = "".join(random.choice("abcdefgh") for _ in range(900))
WORDS = [VOCAB[i : i + random.randint(2, 7)] for i in range(0, 890, 3)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def corpus():
    docs = {i: "shared line here\n" + prose(70) for i in range(40)}
    docs[40] = docs[3] + " more"
    docs[41] = docs[5]
    docs[42] = docs[7].replace(WORDS[0], WORDS[0] + "x", 1)
    docs[43] = "%%% ### $$$ ||| &&& *** " * 20
    docs[44] = prose(30) + " q w e r t y u i o p " + prose(20)
    docs[45], docs[46] = None, ""
    return docs


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "Q w E r t y u i o p"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = len(made(spark))
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(made(spark)) == before + 1  # of all tables made on the way the last stage's input is left

    d, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in kn_quality.classify(d, labels).filter("kept").collect()}
    assert 43 not in kept and set(range(40)) <= kept  # junk goes, clean documents stay
    docs = {i: t or "" for i, t in docs.items() if i in kept}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.UP)
    seen = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")})
    docs = {i: "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10) for i, t in docs.items()}
    docs = {i: docs[i] for i, (_, c) in brute.near_duplicates(list(docs.items())).items() if i == c}
    items = [["q", "w", "e", "r", "t", "y", "u", "i", "o", "p"]]
    words = {i: brute.PLAIN.findall(t.translate(brute.UP)) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not any(words[i][k : k + 10] in items for k in range(len(words[i])))}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}
    assert got == {i: (len(x), brute.sha(t.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert 41 not in got and 44 not in got


def test_stages_keep_the_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe"]


#: Names that stages use inside themselves, or used to.
CLASH = ["_id", "_key", "__lines", "_text_key", "__gone", "id", "key", "gone", "lines", "text_key", "root", "fp", "kept", "gram", "a", "n"]


def odd_docs(spark, n=12):
    rows = [(i, "shared line\n" + prose(40), "en", "s", 5) for i in range(n)] + [(3, "shared line\n" + prose(40), None, None, None), (None, None, None, None, None), (20, "", "de", "s", 0), (21, " ".join(["word"] * 50_000), "en", "s", 1)]
    rows += [rows[0], rows[-2]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    return d.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    """Every stage keeps the columns, whatever their names, and their values; an empty table stays one."""
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q w e r t y u i o p"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            if name == "bpe":
                assert len(rows) == given.count()
                continue
            assert out.columns == docs.columns and (given is docs) == bool(rows), name
            for r in rows:
                assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for c in CLASH), name
