"""Language identification by compression.

For each language a raw-content dictionary is made of whole training texts. Texts are reduced to lower-case
letters and single spaces on both sides, so that junk symbols and capitals say nothing. A text is compressed with the
dictionary of each language; the smallest result names the language, and a narrow margin to the second
is reported as a rejection. The dictionaries hold a bounded sample of labelled rows: in the order of a hash of their
ids, texts as many as ``sample_docs`` and ``dict_bytes`` allow. A text gives a quarter of ``dict_bytes`` at most: a longer one
gives a run of its words of that size, from a place that is chosen by a hash, so a language of long texts only is learned
like any other. Every text to predict is scored whole.

Defined cases: null text and text without a letter are ``und`` with score 0; a language whose sampled texts have no letter is
unknown; a null id is not held out; with no training rows at all everything is ``und``; ties go to the language with most training rows, then
to the first name; repeated
rows each get their own result row; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS, DICT_BYTES, LEVEL = 200, 112 << 10, 6


NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters, with one space for all else."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _piece(text: Column, place: Column, most: int) -> Column:
    """The text, or of one of more than ``most`` bytes about that much from a place given by a hash; cut words at its ends go."""
    chars = F.greatest(F.lit(1), F.floor(F.length(text) * (most / F.octet_length(text)))).cast("int")
    start = F.pmod(place, F.length(text) - chars + 1).cast("int")
    run = F.regexp_replace(text.substr(start + 1, chars), r"^\S*\s|\s\S*$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(run)


def dictionaries(train: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Language -> raw content, the language with most training rows first; ``train`` has the rows that may be learned from."""
    t = train.select(*[F.col(f"`{c}`").cast(kind).alias(n) for c, kind, n in ((lang_col, "string", "lang"), (id_col, "string", "id"), (text_col, "string", "text"))])
    t = t.filter("lang is not null and length(text) > 0")
    totals = {r["lang"]: r["count"] for r in t.groupBy("lang").count().collect()}
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    t = t.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample_docs)
    t = t.withColumn("text", _piece(F.col("text"), F.xxhash64("id", F.lit(1)), dict_bytes // 4)).withColumn("size", F.octet_length("text"))
    t = t.withColumn("total", F.sum(F.col("size") + 1).over(Window.partitionBy("lang").orderBy("rank"))).filter(F.col("total") <= dict_bytes)
    in_order = F.sort_array(F.collect_list(F.struct("rank", "text")))
    rows = t.groupBy("lang").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text")).collect()
    return {r["lang"]: letters(r["text"]) for r in sorted(rows, key=lambda r: (-totals[r["lang"]], r["lang"]))}


def identify(docs: DataFrame, dicts: dict[str, bytes], level: int = LEVEL, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1), rejected (the margin is narrow)."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = list(dicts)

    def run(batches):
        import zstandard as z

        coders = []
        for name in names:
            content = z.ZstdCompressionDict(dicts[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coders.append(z.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False))

        def judge(text):
            if text is None or not names or not any(map(str.isalpha, text)):
                return "und", 0.0, True
            raw = letters(text)
            sizes = sorted((len(c.compress(raw)), k) for k, c in enumerate(coders))
            best, second = sizes[0], sizes[min(1, len(sizes) - 1)]
            gain = (second[0] - best[0]) / second[0] if len(sizes) > 1 else 1.0
            return names[best[1]], max(0.0, min(1.0, gain)), gain < margin

        for b in batches:
            found = [judge(x) for x in b.column(1).to_pylist()]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return d.mapInArrow(run, schema)
