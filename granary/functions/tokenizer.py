"""Tokenizers, batched over Arrow: one id a byte, or a library's subwords. Ids travel as 16-bit little-endian bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import BOS, BYTE_BASE, EOS, is_blank, strip, word_count

#: Bytes that one step works on, and those where a library's ids become Python's numbers; a longer value is a step of its own.
STEP_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
_loaded: dict[str, object] = {}


def processor(proto: bytes):
    """One library handle a worker process and model."""
    import sentencepiece

    key = hashlib.sha256(proto).hexdigest()
    if key not in _loaded:
        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return _loaded[key]


def check(proto: bytes) -> int:
    """The vocabulary's size; begin and end must have ids 1 and 2, and all ids must fit 16 bits."""
    own = processor(proto)
    if (own.bos_id(), own.eos_id()) != (BOS, EOS) or own.unk_id() != 0:
        raise ValueError("the unknown, begin and end ids must be 0, 1 and 2")
    if own.vocab_size() > 1 << 16:
        raise ValueError("the vocabulary must fit 16 bits")
    return own.vocab_size()


def encoded(docs: DataFrame, proto: bytes, *, framed: bool = True) -> DataFrame:
    """doc_id, ids. framed: stripped texts between begin and end ids, blank ones left out; else every text as it is, with neither."""
    check(proto)
    rows = docs.filter(~is_blank(F.col("text"))) if framed else docs
    rows = rows.select("doc_id", (strip(F.col("text")) if framed else F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(proto)
        for batch in batches:
            for lo, hi in steps(batch.column(1), PIECE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = own.encode(part.column(1).to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[BOS, *x, EOS] if framed else x for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def steps(values: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """First row and row after the last of runs of at most `most` bytes of texts, binary values or lists of 32-bit ids, one value at least."""
    sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends, lo = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(values):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lo, hi
        lo = hi


def _framed_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each text's UTF-8 bytes between a begin and an end id, and where each text's begin."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0] + 2 * np.arange(len(texts) + 1)
    out, inner = np.empty(int(at[-1]), np.uint16), np.ones(int(at[-1]), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = data.astype(np.uint16) + np.uint16(BYTE_BASE)
    out[at[:-1]], out[at[1:] - 1] = BOS, EOS
    return out, at


def _framed_pieces(own, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = own.encode(texts.to_pylist(), num_threads=1)
    at = np.concatenate([[0], np.cumsum([len(x) + 2 for x in found])])
    return np.array([i for x in found for i in (BOS, *x, EOS)], np.uint16), at


def raw_array(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value of 16-bit ids for each run of ids."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])


def raw_ids(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all values of a binary array, and where each one's begin."""
    raw = raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view("<u2"), (offsets - offsets[0]) // 2


def framed_steps(texts: pa.Array, proto: bytes | None = None) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, ids between a begin and an end id) of stripped texts, some at a time; without a sentencepiece model, an id a byte."""
    for lo, hi in steps(texts, PIECE_BYTES if proto else STEP_BYTES):
        ids, at = _framed_pieces(processor(proto), texts.slice(lo, hi - lo)) if proto else _framed_bytes(texts.slice(lo, hi - lo))
        yield lo, hi, raw_array(ids, at)


def framed_tokens(docs: DataFrame, proto: bytes | None = None) -> DataFrame:
    """doc_id, raw: each stripped text's ids between a begin and an end id, as 16-bit bytes; blank texts go.

    proto: a sentencepiece model; without one, an id a byte.
    """
    if proto:
        check(proto)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw in framed_steps(batch.column(1), proto):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), raw], ["doc_id", "raw"])

    return docs.filter(~is_blank(F.col("text"))).select("doc_id", strip(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, raw binary")


def with_ids(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the named binary columns (raw, if none is named) as arrays of ids; raw is then called ids."""
    columns = columns or ("raw",)
    fields = [("ids" if c == "raw" else c, "array<int>") if c in columns else (c, kind) for c, kind in rows.dtypes]
    places = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(places[0])):
                own = batch.slice(lo, hi - lo).columns
                for place in places:
                    ids, at = raw_ids(own[place])
                    own[place] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(own, [name for name, _ in fields])

    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in fields))


def decoded(rows: DataFrame, proto: bytes) -> DataFrame:
    """doc_id, text of rows (doc_id, ids array<int>) by the library's decoder, which leaves begin and end ids out; null ids give an empty text."""
    check(proto)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(proto)
        for batch in batches:
            for lo, hi in steps(batch.column(1), PIECE_BYTES):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def token_measures(docs: DataFrame, proto: bytes) -> DataFrame:
    """doc_id, n_chars, n_words, n_tokens of each text as it is, blank ones too; no begin or end id is counted."""
    check(proto)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(proto)
        for batch in batches:
            for lo, hi in steps(batch.column(3), PIECE_BYTES):
                part = batch.slice(lo, hi - lo)
                n = [len(x) for x in own.encode(part.column(3).to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_words", "n_tokens"])

    rows = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), word_count(text).alias("n_words"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, n_words long, n_tokens long")


def draw(probabilities: Column, uniform: Column) -> Column:
    """The place, from 0, where the running sum of probabilities first exceeds a number from 0 to 1."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(s, p):
        total = s["sum"] + p
        return F.struct(total.alias("sum"), F.when((s["at"] < 0) & (total > uniform), s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    last = F.size(F.filter(probabilities, lambda p: p >= 0)) - 1
    return F.aggregate(probabilities, start, step, lambda s: F.when(s["at"] < 0, last).otherwise(s["at"]))
