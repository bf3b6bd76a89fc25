"""BPE encoding and decoding with a published vocabulary.

Texts are cut at ASCII white space, which no token of the vocabulary crosses, and each block of
documents keeps a table of its distinct words: a word is encoded once, and the ids are joined back by
position. Decoding joins ids to their pieces.

The table is kept per Arrow batch, not for the whole corpus: a corpus-wide table has to send one
row per word position through a shuffle (about three times the input), see the README. The result
is the same, since the ids of a word depend on nothing but the word.

Defined cases: null and empty text give no ids and an empty decoded text; repeated rows each get
their own result row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import frugal, keyed, text_blocks

#: Words encoded by the library at a time, and bytes of text whose words are tabled at a time.
WORDS, BLOCK = 20_000, 16 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Encoder and decoder of blocks of texts; one per task."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = pa.array([self.tokenizer.id_to_token(i) for i in range(n)], pa.string())

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        ids, counts = [], []
        for k in range(0, len(words), WORDS):
            for e in self.tokenizer.encode_batch_fast(words.slice(k, WORDS).to_pylist(), add_special_tokens=False):
                ids += e.ids
                counts.append(len(e.ids))
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text in them."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        table = flat.dictionary_encode()
        ids, counts = self.encode_words(table.dictionary)
        firsts = np.concatenate(([0], np.cumsum(counts)))
        at = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Position by position: the run of ids of each word.
        n = counts[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[at] - (ends - n), n) if len(at) else np.zeros(0, np.int64)
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], ends))[offsets - offsets[0]]
        return ids[take] if len(take) else np.zeros(0, np.uint32), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The pieces of each text's ids, as the library joins them when a vocabulary names no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.pieces.take(pa.array(ids))), " ")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    d = keyed(docs, id_col, text_col).select("doc_id", "text")
    schema = T.StructType([d.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = Codec(path or default_path())
        for b in batches:
            for part in text_blocks(b, "text", BLOCK):
                ids, bounds = codec.encode(part.column(1).cast(pa.string()))
                out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc_id", "ids"])

    return d.mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): ids joined to their pieces."""
    schema = T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = Codec(path or default_path())
        for b in batches:
            column = b.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([b.column(0), column, codec.decode(flat, bounds)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; encoded and decoded in one pass over the blocks."""
    from hashlib import sha256

    d = keyed(docs, id_col, text_col).select("doc_id", "text")
    schema = T.StructType([d.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        codec = Codec(path or default_path())
        for b in batches:
            for part in text_blocks(b, "text", BLOCK):
                ids, bounds = codec.encode(part.column(1).cast(pa.string()))
                runs = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(r) for r in runs], pa.int64()), pa.array([sha256(r.astype("<u4").tobytes()).hexdigest() for r in runs], pa.string()), pa.array([sha256(x.as_buffer()).hexdigest() for x in codec.decode(ids, bounds)], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return d.mapInArrow(frugal(run), schema)
