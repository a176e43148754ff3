"""What a task holds in Python stays small, whatever a batch has."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from granary.functions.tokenizer import decoded, encoded, framed_steps, processor, raw_array, with_ids
from granary.operators import corpus
from granary.plans import catalog


def peak(work) -> float:
    """MB that Python and numpy had at most while work ran."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_digests_of_a_large_batch_take_little_memory():
    ids = (np.arange(3_000_000) * 7919 % 65536).astype(np.uint16)
    at = np.array([0, 0, 1, *range(1000, 1_000_001, 1000), 3_000_000])
    raw = raw_array(ids, at)
    want = [hashlib.md5(",".join(map(str, ids[lo:hi].tolist())).encode()).hexdigest() for lo, hi in zip(at[:-1], at[1:], strict=True)]
    assert catalog._digest(raw).to_pylist() == want and catalog._digest(raw.slice(2)).to_pylist() == want[2:]
    assert peak(lambda: catalog._digest(raw)) < 20
    assert catalog._digest(pa.array([], pa.binary())).to_pylist() == []


def test_blocks_of_a_large_batch_take_little_memory():
    ids = (np.arange(12_000_000) % 60_000).astype(np.uint16)
    at = np.arange(0, 12_000_001, 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(at[:-1]), pa.array(np.diff(at)), raw_array(ids, at)], ["start_pos", "n_tokens", "raw"])
    got = {}

    def cut():
        for out in corpus._cut(1024)(iter([batch])):
            got.update({(r["block_id"], r["from_pos"]): hashlib.md5(r["raw"]).digest() for r in out.to_pylist() if r["whole"]})

    assert peak(lambda: sum(out.num_rows for out in corpus._cut(1024)(iter([batch])))) < 40
    cut()
    assert got == {(b, 1024 * b): hashlib.md5(ids[1024 * b : 1024 * b + 1025].tobytes()).digest() for b in range((12_000_000 - 1) // 1024)}


class Rows:
    """Takes the place of a DataFrame, to get at the function that mapInArrow would run."""

    def __init__(self, *dtypes):
        self.dtypes, self.columns = list(dtypes), [c for c, _ in dtypes]

    def mapInArrow(self, run, schema):
        return run


def test_ids_of_a_large_batch_come_in_parts():
    ids = (np.arange(8_000_000) % 60_000).astype(np.uint16)
    at = np.arange(0, 8_000_001, 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), raw_array(ids, at)], ["n", "raw"])
    run = with_ids(Rows(("n", "long"), ("raw", "binary")))
    assert peak(lambda: sum(out.num_rows for out in run(iter([batch])))) < 20  # two parts
    out = pa.Table.from_batches(run(iter([batch, batch.slice(0, 0)])))
    assert out.column("n").to_pylist() == list(range(8000)) and (out.column("ids").combine_chunks().flatten().to_numpy() == ids).all()


def test_encoded_and_decoded_texts_come_in_parts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    proto, text = catalog._piece_model(), "some words of a text, again and again. " * 500
    texts = [f"{i} {text}"[: 20_000 + i] for i in range(150)]

    def functions(work):
        found = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(type(docs), "mapInArrow", lambda rows, run, schema: found.append(run) or rows)
            work()
        return found[0]

    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts)], ["doc_id", "text"])
    ids = list(functions(lambda: encoded(docs, proto))(iter([batch])))
    assert len(ids) >= 3 and [i for part in ids for i in part.column(0).to_pylist()] == list(range(150))
    whole = pa.Table.from_batches(ids).combine_chunks().to_batches()[0]
    assert whole.column(1).to_pylist()[::50] == [[1, *processor(proto).encode(x), 2] for x in texts[::50]]
    many = pa.Table.from_batches([whole] * 4).combine_chunks().to_batches()[0]
    back = list(functions(lambda: decoded(docs.selectExpr("doc_id", "array(1) AS ids"), proto))(iter([many])))
    assert len(back) >= 3 and [x for part in back for x in part.column(1).to_pylist()] == processor(proto).decode(whole.column(1).to_pylist()) * 4


def test_framed_pieces_come_in_parts():
    proto, text = catalog._piece_model(), "some words of a text, again and again. " * 500
    texts = [f"{i} {text}"[: 20_000 + i] for i in range(150)]
    parts = list(framed_steps(pa.array(texts), proto))
    assert len(parts) >= 3 and [i for lo, hi, _ in parts for i in range(lo, hi)] == list(range(150))
    found = [np.frombuffer(x, "<u2").tolist() for *_, raw in parts for x in raw.to_pylist()]
    assert found == [[1, *x, 2] for x in processor(proto).encode(texts)]
