"""What a task of op2 holds beside its batch does not follow the batch."""

import numpy as np
import pyarrow as pa

from caseloom.llm import suffix_dedup


def test_tables_of_powers_are_small():
    suffix_dedup._TABLES.clear()
    suffix_dedup.Rolling(np.zeros(2 * suffix_dedup.BLOCK, np.uint8))  # the most that is joined to one run
    assert sum(x.nbytes for t in suffix_dedup._TABLES.values() for x in t) <= 20e6
    suffix_dedup._TABLES.clear()


def test_texts_are_cut_piece_by_piece():
    """Rows at the head, in the middle and at the end of a batch of 6 MB, with spans, empty lists and nulls."""
    texts = [bytes([65 + i % 26]) * (20_000 + i) for i in range(300)]
    spans = [[{"start": 5, "end": 400 + i}, {"start": 300, "end": 500 + i}, {"start": 1000, "end": 1400}] if i % 3 == 0 else [] if i % 3 == 1 else None for i in range(300)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.binary()), pa.array(spans, kind)], ["id", "raw", "spans"])
    out = list(suffix_dedup._cut_texts([batch.slice(1), batch.slice(0, 1)]))
    assert len(out) >= 5 and max(b.nbytes for b in out) <= 2e6
    got = {r["doc_id"]: r for b in out for r in b.to_pylist()}
    assert len(got) == 300
    for i, t in enumerate(texts):
        kept = t[:5] + t[500 + i : 1000] + t[1400:] if i % 3 == 0 and 500 + i < 1000 else t
        want = (len(t), len(t) - len(kept), 2 if i % 3 == 0 else 0, kept)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept"]) == want, i
