"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch of texts are put in a trie, one level a byte, held as arrays. The best unigram score
and its number of tokens are worked out once for each node, from the ancestors at the lengths that pieces have; what a
node ends is the count of the pre-token, and a text's count is the sum over its pre-tokens. A branch on which a single
pre-token is left shares nothing more: its rest is worked out from the state at its last node, byte by byte.

The vocabulary is a public model's pieces. That model has ranks, no probabilities, and no tokenizer is trained here, so
the unigram model is an estimate: P(piece) = 1 / (rank + 2.7), normalised, the Zipf-Mandelbrot law of word frequencies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from granary.llm.common import Spans, text_slabs

SPACE = "▁"
_SPACE_BYTE, _LINE_BYTE = 32, 10
_FILTER_BITS = 21
#: Fixed value: the shift of the rank in the law of frequencies.
_SHIFT = 2.7
#: Branches of one pre-token each that are left when the rest is worked out byte by byte; a level in numpy costs as much as some of these.
_BRANCHES = 24


def unigram_scores(model) -> dict[str, float]:
    """Natural-log probabilities of a sentencepiece model's ordinary pieces, from their rank by the model's own score."""
    pieces = sorted((p for p in model.pieces if p.type == 1), key=lambda p: (-p.score, p.piece))
    mass = np.array([1 / (rank + _SHIFT) for rank in range(1, len(pieces) + 1)])
    return {p.piece.replace(SPACE, " "): score for p, score in zip(pieces, np.log(mass / mass.sum()).tolist(), strict=True)}


class UnigramTrie:
    """count(pre-tokens) under the pieces of a sentencepiece model; a space stands for the model's space sign."""

    def __init__(self, proto: bytes, cache: int = 2_000_000):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        pieces = unigram_scores(model)
        if any(" " in p.lstrip(" ") or "\n" in p.strip("\n") for p in pieces):
            raise ValueError("pieces must not span a space or a line end between other characters")
        self.unknown = min(pieces.values()) - 10.0
        self.tokens_of_unknown = model.trainer_spec.byte_fallback
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        lengths = np.array([len(x) for x in raw])
        hashes = Spans(data).hash(ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(pieces.values()))[order]
        self.lengths = sorted(set(lengths.tolist()), reverse=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.limit = cache
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _scores(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and those pieces' scores."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], self.scores[at[hit]]

    def _trie(self, data: np.ndarray, spans: Spans, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of the distinct pre-tokens at these places."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        alive_at = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
        out = np.zeros(len(size), np.int64)
        nodes, best, count = [np.zeros(len(size), np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for depth, alive in enumerate(alive_at, 1):
            begin = starts[:alive]
            _, first, node = np.unique(spans.hash(begin, begin + depth), return_index=True, return_inverse=True)
            at = begin[first] + depth  # where a text that passes through the node goes on
            score, tokens = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
            lead = {}  # lengths that the last code point may have, and the nodes where it does
            for width in range(1, min(4, depth) + 1):
                byte = data[at - width]
                wide = 1 if width == 1 else (0xC0, 0xE0, 0xF0)[width - 2]
                is_lead = byte < 0x80 if width == 1 else (byte >= wide) & (byte < (0xE0, 0xF0, 0x100)[width - 2])
                lead[width] = is_lead
            for length in self.lengths:
                if length > depth:
                    continue
                which, gain = self._scores(spans.hash(at - length, at))
                self._offer(which, gain, np.ones(len(which), np.int64), depth - length, first, nodes, best, count, score, tokens)
                if length in lead:
                    alone = lead[length].copy()
                    alone[which] = False
                    which = np.flatnonzero(alone)
                    n = length if self.tokens_of_unknown else 1
                    self._offer(which, np.full(len(which), self.unknown), np.full(len(which), n), depth - length, first, nodes, best, count, score, tokens)
            nodes.append(node)
            best.append(score)
            count.append(tokens)
            if depth > self.lengths[0]:  # no piece reaches back further
                nodes[depth - self.lengths[0] - 1] = best[depth - self.lengths[0] - 1] = count[depth - self.lengths[0] - 1] = None
            over = np.flatnonzero(size[:alive] == depth)
            out[over] = tokens[node[over]]
            if depth >= self.lengths[0] and len(first) == alive <= _BRANCHES:
                for i in np.flatnonzero(size[:alive] > depth).tolist():
                    steps = range(depth - self.lengths[0], depth + 1)
                    before = [(float(best[k][nodes[k][i]]), int(count[k][nodes[k][i]])) for k in steps]
                    out[i] = self._rest(data, spans, int(starts[i]), int(starts[i] + size[i]), depth, before)
                break
        back = np.empty(len(out), np.int64)
        back[order] = out
        return back

    def _rest(self, data: np.ndarray, spans: Spans, start: int, end: int, depth: int, before: list[tuple[float, int]]) -> int:
        """Token count of the pre-token, from the (score, tokens) of its last lengths up to `depth`, the longest piece's many."""
        reach = len(before) - 1
        begin = start + depth - reach  # no piece that ends past `depth` starts before
        size, own, known = end - begin, data[begin:end], reach
        ends, lengths, gains, tokens = [], [], [], []

        def add(at: np.ndarray, length: int, gain: np.ndarray, n: int) -> None:
            later = at + length > known
            ends.append((at + length)[later])
            lengths.append(np.full(int(later.sum()), length))
            gains.append(gain[later])
            tokens.append(np.full(int(later.sum()), n))

        for length in self.lengths:
            if length > size:
                continue
            at = np.arange(begin, end - length + 1)
            which, gain = self._scores(spans.hash(at, at + length))
            add(which, length, gain, 1)
            if length <= 4:
                low, high = ((0, 0x80), (0xC0, 0xE0), (0xE0, 0xF0), (0xF0, 0x100))[length - 1]
                lone = (own >= low) & (own < high)
                lone[which] = False
                lone[size - length + 1 :] = False
                which = np.flatnonzero(lone)
                add(which, length, np.full(len(which), self.unknown), length if self.tokens_of_unknown else 1)
        ends, lengths, gains, tokens = map(np.concatenate, (ends, lengths, gains, tokens))
        order = np.lexsort((-lengths, ends))
        best = [x for x, _ in before] + [-np.inf] * (size - known)
        count = [x for _, x in before] + [0] * (size - known)
        for e, length, gain, n in zip(ends[order].tolist(), lengths[order].tolist(), gains[order].tolist(), tokens[order].tolist(), strict=True):
            if (total := best[e - length] + gain) > best[e]:
                best[e], count[e] = total, count[e - length] + n
        return count[size]

    @staticmethod
    def _offer(which, gain, n, depth, first, nodes, best, count, score, tokens) -> None:
        """A piece that ends at the nodes `which`: taken where strictly better, so the earliest start wins among equals."""
        if len(which):
            above = nodes[depth][first[which]]
            total = best[depth][above] + gain
            better = total > score[which]
            score[which[better]] = total[better]
            tokens[which[better]] = count[depth][above[better]] + n[better]

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of the pre-tokens at these places, each distinct one worked out once."""
        spans = Spans(data)
        hashes, first, node = np.unique(spans.hash(starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        have = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        counts = np.zeros(len(hashes), np.int64)
        counts[have] = self.counts[at[have]]
        new = first[~have]
        counts[~have] = self._trie(data, spans, starts[new], ends[new])
        if len(self.known) + len(new) > self.limit:
            self.known, self.counts = hashes, counts
        else:
            where = np.searchsorted(self.known, hashes[~have])
            self.known, self.counts = np.insert(self.known, where, hashes[~have]), np.insert(self.counts, where, counts[~have])
        return counts[node]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens, and each text's first: cut before each run of spaces and around each line end."""
    space, line = data == _SPACE_BYTE, data == _LINE_BYTE
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] |= line
    cut[1:] |= line
    cut[1:-1] |= space[1:] & ~space[:-1]
    cut[offsets] = True
    cut[len(data)] = True
    marks = np.flatnonzero(cut)
    return marks[:-1], marks[1:], np.searchsorted(marks, offsets)


_tries: dict[str, UnigramTrie] = {}


def _trie(proto: bytes) -> UnigramTrie:
    key = hashlib.sha256(proto).hexdigest()
    if key not in _tries:
        _tries[key] = UnigramTrie(proto)
    return _tries[key]


def token_counts(docs: DataFrame, proto: bytes, *, text: str = "text", slab_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of each text under the best unigram segmentation.

    A space is put before each text, as the model's own normaliser does. Null and empty texts have none of either;
    repeated rows and ids are counted each on its own; an empty table gives no rows; other columns are not read. A code
    point that no piece holds is a token for each of its bytes. Memory follows `slab_bytes`, or the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(proto)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            texts = pc.replace_substring(texts, SPACE, " ")
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
            tokens, pre = [], []
            for _, _, data, offsets in text_slabs(texts, slab_bytes):
                starts, ends, first = pre_tokens(data, offsets)
                sums = np.concatenate([[0], np.cumsum(trie.count(data, starts, ends))]) if len(starts) else np.zeros(1, np.int64)
                tokens.append(np.diff(sums[first]))
                pre.append(np.diff(first))
            if batch.num_rows:
                columns = [batch.column(0), pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(pre), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_pretokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
