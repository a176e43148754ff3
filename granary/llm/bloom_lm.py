"""Language-model scoring from a log-frequency Bloom filter.

A quantised count of level q is held as q memberships of its n-gram, (n-gram, 1) to (n-gram, q); reading asks for level
1, 2, ... until one is absent. The filter is cut by hash into segments, as many as shuffles have partitions and more where
the texts' bytes ask for it; each is built by the task that has merged the counts of its part and kept as a row in the
shared folder, so the filter grows with the texts and is nowhere held whole. Scoring sends its questions, once for each chunk of texts, to the task that has the
segment, and the answers back to the chunk.

Counting: each task sums its own n-grams in numpy and sends, for each segment, one block of sorted hashes and counts, so
a frequent n-gram is one entry a task.

The model, for a word w after v: (c(v,w) + (c(v) - s(v) + mu) p(w)) / (c(v) + mu), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
Counts are read from the filter, rounded down where they raise the sum over w and up where they lower it; s(v) is the
sum of c(v,.) over all pairs, as rounded. So the probabilities after v sum to 1 at most, but for false positives.

Base scores need each token's exact count. Counts of frequent tokens are broadcast, at most `frequent` of them; the
others' are joined by hash, so that only rare tokens are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, SOLID, Spans, mix64, text_slabs, trimmed, whole_groups, words, written

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Words, pairs and contexts are different members of the filter.
_KINDS = {"w": np.uint64(0), "p": np.uint64(0xD1342543DE82EF95), "s": np.uint64(0x2545F4914F6CDD1D)}
#: The least count of each level: every count up to 3, then steps of half as much again.
_LEVELS = [1]
while _LEVELS[-1] < 1 << 62:
    _LEVELS.append(max(_LEVELS[-1] + 1, _LEVELS[-1] * 3 // 2))
LEVELS = np.array(_LEVELS, np.int64)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """36 bits of the left hash on top, so that the context can be told from a pair, and 28 of the right one.

    Of 1e8 distinct tokens, one in 700 shares its context with another; after a token with a million different successors,
    one in 270 of the words that never follow it is taken for one that does.
    """
    return (context_key(left) << np.uint64(28)) | (right >> np.uint64(36))


def context_key(left: np.ndarray) -> np.ndarray:
    return left >> np.uint64(28)


def member(kind: str, keys: np.ndarray) -> np.ndarray:
    """48 bits of hash on top of 16 zeros, which pack() makes nothing of; of 2^31 others, one is equal with probability 1e-5."""
    return mix64(keys ^ _KINDS[kind]) & np.uint64(2**64 - 2**16)


def level(counts: np.ndarray) -> np.ndarray:
    """Of each count, at least 1: the last level that it reaches."""
    return np.searchsorted(LEVELS, counts, "right")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, each text's followed by END, and each text's first."""
    starts, ends, first = words(data, offsets, SOLID)
    n = len(offsets) - 1
    count = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[begin[1:] - 1] = True
    out[last], out[~last] = END, Spans(data, LOWER).hash(starts, ends) if n else np.zeros(0, np.uint64)
    return out, begin


def left_of(own: np.ndarray, begin: np.ndarray, start: np.uint64 | int = START) -> np.ndarray:
    """The token before each; `start` before those at `begin`."""
    left = np.empty_like(own)
    left[1:] = own[:-1]
    left[begin] = start
    return left


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes and their counts, bytes of one place together, compressed."""
    small = np.minimum(counts, 255).astype(np.uint8)
    hashes = np.ascontiguousarray(hashes)
    raw = [np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8).T).tobytes(), small.tobytes(), counts[counts >= 255].astype(np.int64).tobytes()]
    whole = b"".join(raw)
    return len(hashes).to_bytes(8, "little") + len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    whole = pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True)
    hashes = np.ascontiguousarray(np.frombuffer(whole, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).reshape(-1)
    counts = np.frombuffer(whole, np.uint8, n, 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(whole, np.int64, -1, 9 * n)
    return hashes, counts


def _sum(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the sums of their counts."""
    if counts is None:
        return np.unique(hashes, return_counts=True) if len(hashes) else (hashes, np.zeros(0, np.int64))
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    return hashes[first], np.add.reduceat(counts, first) if len(hashes) else counts


def segment_of(members: np.ndarray, segments: int) -> np.ndarray:
    return (((members >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _blocks(kind: str, keys: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[tuple[str, int, bytes]]:
    """Sorted keys and counts, one block for each segment that any falls in."""
    segment = segment_of(member(kind, keys), segments)
    order = np.argsort(segment.astype(np.uint16 if segments < 1 << 16 else np.int64), kind="stable")
    edges = np.searchsorted(segment[order], np.arange(segments + 1))
    for i in range(segments):
        if edges[i] < edges[i + 1]:
            own = order[edges[i] : edges[i + 1]]
            yield kind, i, pack(keys[own], counts[own])


def _rows(found) -> Iterator[pa.RecordBatch]:
    for kind, segment, blob in found:
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([segment], pa.int32()), pa.array([blob], pa.binary())], ["kind", "segment", "blob"])


_BLOCKS = "kind string, segment int, blob binary"
_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _by_segment(batches: Iterator[pa.RecordBatch], enough: int = 8_000_000) -> dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The sums of all blocks of a partition by segment and kind; blocks are summed whenever `enough` entries wait."""
    found: dict[tuple[int, str], list] = {}
    waiting: dict[tuple[int, str], int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = row["segment"], row["kind"]
            found.setdefault(key, []).append(unpack(row["blob"]))
            waiting[key] = waiting.get(key, 0) + len(found[key][-1][0])
            if waiting[key] >= enough:
                found[key], waiting[key] = [_merged(found[key])], 0
    out: dict[int, dict] = {}
    for (segment, kind), parts in found.items():
        out.setdefault(segment, {})[kind] = _merged(parts)
    return out


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    return _sum(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))


@dataclass
class BloomLM:
    """Segments of bits as one array, each segment's first word and number of bits, and the model's constants."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray
    probes: int
    train_tokens: int
    distinct: int
    mu: float = 64.0

    def levels(self, kind: str, keys: np.ndarray) -> np.ndarray:
        return self.held(member(kind, keys))

    def held(self, members: np.ndarray) -> np.ndarray:
        """The level of each member, by one membership question after another."""
        out = np.zeros(len(members), np.int64)
        segment = segment_of(members, len(self.size)) if len(self.size) else out
        first, size = (self.first[segment], self.size[segment].astype(np.uint64)) if len(self.size) else (out, out)
        alive = np.flatnonzero(size > 0)
        for q in range(1, len(LEVELS) + 1):
            for probe in range(self.probes):
                bit = position(members[alive], q, probe) % size[alive]
                alive = alive[self.bits[first[alive] + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1]
            if not len(alive):
                break
            out[alive] = q
        return out


@dataclass
class StoredLM:
    """The segments as rows (segment, filter) of a table in the shared folder, and the model's constants."""

    filters: DataFrame
    segments: int
    probes: int
    train_tokens: int
    distinct: int
    mu: float = 64.0

    @property
    def bits(self) -> np.ndarray:
        """The whole filter here; for small ones alone."""
        return self.gathered().bits

    def gathered(self) -> BloomLM:
        bits, first, size, at = [np.zeros(0, np.uint64)], np.zeros(self.segments, np.int64), np.zeros(self.segments, np.int64), 0
        for part in self.filters.orderBy("segment").collect():
            own = np.frombuffer(part["filter"], np.uint64)
            first[part["segment"]], size[part["segment"]] = at, 64 * len(own)
            bits.append(own)
            at += len(own)
        return BloomLM(np.concatenate(bits), first, size, self.probes, self.train_tokens, self.distinct, self.mu)


@dataclass
class Chunk:
    """Some whole texts: row ids, each one's first token, distinct hashes, and each token's place in these.

    START is the first hash; the others go by how often they come, which makes the places small.
    """

    rows: np.ndarray
    begin: np.ndarray
    names: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Chunk:
        """parts: row ids, tokens and begins of slabs."""
        names, own, times = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(1, len(order) + 1)
        count = np.concatenate([np.diff(x[2]) for x in parts])
        return cls(np.concatenate([x[0] for x in parts]), np.concatenate([[0], np.cumsum(count)]), np.append(START, names[order]), place[own])

    def packed(self) -> bytes:
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T) for x in (self.names, self.own)]
        raw = [x.tobytes() for x in (self.rows.astype(np.int64), self.begin.astype(np.int64), *planes)]
        head = np.array([len(self.rows), len(self.names), len(self.own), sum(map(len, raw))], np.int64).tobytes()
        return head + pa.compress(b"".join(raw), codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, blob: bytes) -> Chunk:
        n, v, m, size = (int(x) for x in np.frombuffer(blob, np.int64, 4))
        whole = pa.decompress(blob[32:], decompressed_size=size, codec="zstd", asbytes=True)
        names = np.ascontiguousarray(np.frombuffer(whole, np.uint8, 8 * v, 8 * (2 * n + 1)).reshape(8, v).T).view(np.uint64).reshape(-1)
        own = np.ascontiguousarray(np.frombuffer(whole, np.uint8, 4 * m, 8 * (2 * n + 1 + v)).reshape(4, m).T).view(np.uint32).reshape(-1)
        return cls(np.frombuffer(whole, np.int64, n), np.frombuffer(whole, np.int64, n + 1, 8 * n), names, own)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the left and the own token of each distinct pair, and each token's place among the pairs."""
        left = left_of(self.own, self.begin[:-1], 0)
        both, back = np.unique(left.astype(np.uint64) << np.uint64(32) | self.own, return_inverse=True)
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(2**32 - 1)).astype(np.int64), back

    def members(self, left: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What the filter is asked: the distinct tokens as words, as contexts, and the distinct pairs."""
        times = np.where(self.names == START, END, self.names)  # as many starts as ends
        return np.concatenate([member("w", times), member("s", context_key(self.names)), member("p", pair_key(self.names[left], self.names[own]))])

    def log10(self, levels: np.ndarray, left: np.ndarray, own: np.ndarray, train_tokens: int, distinct: int, mu: float) -> np.ndarray:
        """log10 of the probability of each distinct pair's own token after the left one, from the levels of all members."""
        times, often, pair = np.split(levels, [len(self.names), 2 * len(self.names)])
        single = token_probability(np.where(self.names == START, 0, times), train_tokens, distinct)
        total = np.where(times > 0, LEVELS[times] - 1, 0)
        seen = np.minimum(np.where(often > 0, LEVELS[often] - 1, 0), total)
        count = np.where(pair > 0, LEVELS[np.maximum(pair, 1) - 1], 0)
        count = np.minimum(count, seen[left])
        left_over = (total - seen)[left] + mu
        return np.log10((count + left_over * single[own]) / (total[left] + mu))


def token_probability(q: np.ndarray, train_tokens: int, distinct: int) -> np.ndarray:
    count = np.where(q > 0, LEVELS[np.maximum(q, 1) - 1], 0)
    return (count + 0.5) / (train_tokens + 0.5 * (distinct + 1))


def position(members: np.ndarray, q: int, probe: int) -> np.ndarray:
    return mix64(members ^ np.uint64(((q << 8) | probe) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def build_segment(members: np.ndarray, counts: np.ndarray, probes: int, bits_each: float) -> np.ndarray:
    """64-bit words of one segment that holds these counts, `bits_each` bits a membership."""
    q = level(counts)
    size = -(-int(bits_each * q.sum() + 1) // 64) * 64
    bits = np.zeros(size // 64, np.uint64)
    for at in range(1, int(q.max()) + 1 if len(q) else 0):
        members, q = members[q >= at], q[q >= at]
        for probe in range(probes):
            bit = position(members, at, probe) % np.uint64(size)
            np.bitwise_or.at(bits, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return bits


def train(texts: DataFrame, *, text: str = "text", segments: int | None = None, segment_bytes: int = 256 << 20, probes: int = 4, bits_each: float = 8.0, mu: float = 64.0, flush_tokens: int = 4_000_000) -> tuple[StoredLM, DataFrame]:
    """The model, and the exact counts (kind "w" blocks of token hashes) that it came from.

    The filter has `bits_each` bits, 4 at least, for each membership and holds all of them, at any size of the input.
    `mu` is the weight of p(w) after any word, in occurrences. Without `segments`, there are as many as shuffles have
    partitions, but at least one for each `segment_bytes` bytes of the texts, which bounds what a task holds.
    """
    if bits_each < 4 or probes < 1:
        raise ValueError("a membership needs 4 bits and a probe at least: with less, false ones outweigh the true")
    if not segments:
        size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
        segments = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // segment_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"w": [], "p": []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, found in held.items():
                if found:
                    yield from _rows(_blocks(kind, *_sum(np.concatenate(found)), segments))
                    found.clear()

        for batch in batches:
            for _, _, data, offsets in text_slabs(batch.column(0)):
                own, begin = tokens(data, offsets)
                held["w"].append(own)
                held["p"].append(pair_key(left_of(own, begin[:-1]), own))
                if sum(map(len, held["w"])) >= flush_tokens:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, found in _by_segment(batches).items():
            if "w" in found:
                yield from _rows([("w", segment, pack(*found["w"]))])
            keys, counts = found.get("p", _NONE)
            if len(keys):
                counts = LEVELS[level(counts) - 1]
                yield from _rows([("p", segment, pack(*_sum(member("p", keys), counts)))])  # keys are of no more use
                yield from _rows(_blocks("s", *_sum(context_key(keys), counts), segments))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, found in _by_segment(batches).items():
            w = found.get("w", _NONE)
            members, counts = np.concatenate([x[0] if kind == "p" else member(kind, x[0]) for kind, x in found.items()]), np.concatenate([x[1] for x in found.values()])
            bits = build_segment(members, counts, probes, bits_each)
            columns = [pa.array([segment], pa.int32()), pa.array([int(w[1].sum())], pa.int64()), pa.array([len(w[0])], pa.int64()), pa.array([bits.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "n", "v", "filter"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(trimmed(count), _BLOCKS)
    table = written(counted.repartitionById(segments, F.col("segment")).mapInArrow(trimmed(merge), _BLOCKS), "ngrams")
    parts = written(table.repartitionById(segments, F.col("segment")).mapInArrow(trimmed(build), "segment int, n long, v long, filter binary"), "filter")
    whole = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    model = StoredLM(parts.select("segment", "filter"), segments, probes, whole["n"], whole["v"], mu)
    return model, table.filter("kind = 'w'")


def frequent_tokens(counts: DataFrame, at_most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, in order, and counts of all tokens from some least count on, `at_most` of them, and that count."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                q, n = np.unique(level(unpack(blob)[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int64())], ["q", "n"])

    histogram = {r["q"]: r["n"] for r in counts.select("blob").mapInArrow(levels, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()}
    least, total = len(LEVELS), 0
    while least > 1 and total + histogram.get(least - 1, 0) <= at_most:
        least -= 1
        total += histogram.get(least, 0)
    floor = int(LEVELS[least - 1])

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys, n = unpack(blob)
                if (n >= floor).any():
                    yield pa.RecordBatch.from_arrays([pa.array([pack(keys[n >= floor], n[n >= floor])], pa.binary())], ["blob"])

    parts = [unpack(r["blob"]) for r in counts.select("blob").mapInArrow(large, "blob binary").collect()] or [_NONE]
    return *_merged(parts), floor


_SCORED = "rid long, doc_id {}, held_out boolean, n_tokens long, n_known long, base double, token long, times long, chunk long, blob binary"
_SENT = "chunk long, segment int, blob binary"
#: In place of a segment: a chunk itself. In place of a chunk: a segment's filter. Both sort before what they are needed for.
_ITSELF = -1


def _each_chunk(table: pa.Table) -> Iterator[list[bytes]]:
    keys, blobs = table.column("chunk").to_numpy(), table.column("blob")
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield blobs.slice(lo, hi - lo).to_pylist()


def pair_scores(chunks: DataFrame, model: StoredLM) -> DataFrame:
    """rid, score of all texts in chunks (chunk, blob).

    Questions meet their segment's filter in one task, answers their chunk in another; neither passes the driver.
    """
    segments, probes, constants = model.segments, model.probes, (model.train_tokens, model.distinct, model.mu)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.unpacked(row["blob"])
                members = np.sort(chunk.members(*chunk.pairs()[:2]))
                edges = np.searchsorted(segment_of(members, segments), np.arange(segments + 1))  # segments ascend with members
                for i in np.flatnonzero(edges[1:] > edges[:-1]):
                    own = members[edges[i] : edges[i + 1]]
                    columns = [pa.array([row["chunk"]], pa.int64()), pa.array([i], pa.int32()), pa.array([pack(own, np.ones(len(own), np.int64))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "segment", "blob"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lm = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != at:
                    at, lm = row["segment"], None
                if row["chunk"] == _ITSELF:
                    bits = np.frombuffer(row["blob"], np.uint64)
                    lm = BloomLM(bits, np.zeros(1, np.int64), np.array([64 * len(bits)]), probes, *constants)
                    continue
                members, _ = unpack(row["blob"])
                found = lm.held(members) if lm else np.zeros(len(members), np.int64)
                blob = pa.compress(found.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
                columns = [pa.array([row["chunk"]], pa.int64()), pa.array([at], pa.int32()), pa.array([len(members).to_bytes(8, "little") + blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "segment", "blob"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for itself, *answers in (blobs for table in whole_groups(batches, "chunk") for blobs in _each_chunk(table)):
            chunk = Chunk.unpacked(itself)
            left, own, back = chunk.pairs()
            order = np.argsort(chunk.members(left, own))
            levels = np.zeros(len(order), np.int64)
            levels[order] = np.concatenate([np.frombuffer(pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), np.uint8) for x in answers])
            row = np.repeat(np.arange(len(chunk.rows)), np.diff(chunk.begin))
            score = np.bincount(row, chunk.log10(levels, left, own, *constants)[back], len(chunk.rows))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.rows), pa.array(score)], ["rid", "score"])

    deal = F.pmod(2 * F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(2**32 - 1), F.lit(segments)).cast("int")  # of few chunks, no two to a task
    filters = model.filters.select(F.lit(_ITSELF).cast("long").alias("chunk"), "segment", F.col("filter").alias("blob"))
    asked = chunks.mapInArrow(trimmed(ask), _SENT).unionByName(filters).repartitionById(segments, F.col("segment"))
    answers = asked.sortWithinPartitions("segment", "chunk").mapInArrow(trimmed(answer), _SENT)
    back = answers.unionByName(chunks.withColumn("segment", F.lit(_ITSELF))).repartitionById(segments, deal)
    return back.sortWithinPartitions("chunk", "segment").mapInArrow(trimmed(finish), "rid long, score double")


def score(docs: DataFrame, model: StoredLM, counts: DataFrame, *, text: str = "text", frequent: int = 1 << 20, chunk_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    docs: doc_id, held_out and the text. Null counts as empty: its one token is the end. Repeated rows and ids are
    scored each on its own; an empty table gives no rows; other columns are not read. With no training tokens N and V
    are 0. `frequent` bounds the broadcast of exact counts to 16 bytes each. Texts are put together into chunks of some
    `chunk_tokens` tokens, each of which asks the filter once about each of its distinct tokens and pairs.
    """
    sc = docs.sparkSession.sparkContext
    keys, n, floor = frequent_tokens(counts, frequent)
    exact = sc.broadcast((keys, n))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n = exact.value
        logs = np.log10(known_n + 0.5)
        waiting: list = []
        made = TaskContext.get().partitionId() << 32
        types: list[pa.DataType] = []

        def rows(k: int, **found: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([found.get(name, pa.nulls(k, t)) for name, t in zip(names, types, strict=True)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            yield rows(1, chunk=pa.array([made], pa.int64()), blob=pa.array([Chunk.of(waiting).packed()], pa.binary()))
            waiting.clear()
            made += 1

        for batch in batches:
            types = [pa.int64(), batch.column(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for lo, hi, data, offsets in text_slabs(batch.column(3)):
                own, begin = tokens(data, offsets)
                row = np.repeat(np.arange(hi - lo), np.diff(begin))
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                base = np.bincount(row[hit], logs[at[hit]], hi - lo).astype(float)  # counts, where nothing is known
                n_known = np.bincount(row[hit], minlength=hi - lo)
                head = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                yield rows(hi - lo, rid=head[0], doc_id=head[1], held_out=head[2], n_tokens=pa.array(np.diff(begin), pa.int64()), n_known=pa.array(n_known, pa.int64()), base=pa.array(base))
                rare = np.stack([row[~hit].astype(np.uint64), own[~hit]], axis=1)
                if len(rare):
                    order = np.lexsort((rare[:, 1], rare[:, 0]))
                    rare = rare[order]
                    first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]).any(axis=1)]))
                    times, rare = np.diff(np.append(first, len(rare))), rare[first]
                    of_row = head[0].take(pa.array(rare[:, 0].astype(np.int64)))
                    yield rows(len(rare), rid=of_row, token=pa.array(np.ascontiguousarray(rare[:, 1]).view(np.int64)), times=pa.array(times, pa.int64()))
                waiting.append((head[0].to_numpy(), own, begin))
                if sum(len(x[1]) for x in waiting) >= chunk_tokens:
                    yield from flush()
        if waiting:
            yield from flush()

    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", F.col(text).alias("text_"))
    scored = written(texts.mapInArrow(trimmed(run), _SCORED.format(kind)), "scored")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys, n = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n < floor].view(np.int64)), pa.array(n[n < floor])], ["token", "c"])

    rest = counts.select("blob").mapInArrow(small, "token long, c long")
    found = scored.filter("token is not null").select("rid", "token", "times").join(rest, "token", "left")
    c = F.coalesce("c", F.lit(0))
    found = found.select("rid", (F.col("times") * F.log10(c + 0.5)).alias("more"), F.when(c > 0, F.col("times")).otherwise(0).alias("more_known"))
    pairs = pair_scores(scored.filter("chunk is not null").select("chunk", "blob"), model)
    found = found.unionByName(pairs, allowMissingColumns=True).groupBy("rid").agg(*(F.sum(x).alias(x) for x in ("more", "more_known", "score")))
    whole = float(np.log10(model.train_tokens + 0.5 * (model.distinct + 1)))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)
    return scored.filter("n_tokens is not null").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
