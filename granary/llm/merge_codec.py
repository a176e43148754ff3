"""Exact merge-type encoding by backtracking, and decoding.

The vocabulary is a sentencepiece BPE model with an identity normaliser. Instead of merging a text pair by pair, the
encoder walks left to right with the longest piece that an Aho-Corasick automaton finds at each place. A piece may
follow another only if re-merging the two together gives just these two; where nothing may follow, the place is marked
in a bitfield and the walk takes the next shorter piece. A sequence whose neighbours are all compatible is the one that
merging gives: the first merge across a bound would also happen in the pair alone.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from granary.llm.common import trimmed

SPACE = "▁"
_NORMAL, _BYTE = 1, 6


class MergeCodec:
    """encode(text) and decode(ids) as the sentencepiece library gives them for the model in `proto`."""

    def __init__(self, proto: bytes, cache: int = 250_000):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        norm, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with an identity normaliser that keeps white space is needed")
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not known here")
        self.prefix = norm.add_dummy_prefix
        self.unk, self.eos, self.fallback = trained.unk_id, trained.eos_id, trained.byte_fallback
        self.unk_surface = trained.unk_surface
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        # Where no piece has a space after another character, and none but its own has a line end, texts can be cut there.
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        line = "\n" if apart and not any("\n" in p and len(p) > 1 for p in self.ids) else ""
        self.cut = re.compile(f"{line}|{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s).+")
        self.shown = frozenset(self.ids.values())
        self.shown_as = [p.replace(SPACE, " ") for p in self.pieces]
        self.neighbours = {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)}
        self.limit, self.young, self.old = cache, {}, {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def forget(self) -> None:
        """Empties the caches, which last for a task: the worker may do quite other work next."""
        self.young, self.old, self.parts, self.pairs = {}, {}, {}, {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the neighbours whose union scores most, the leftmost of equals, again and again."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a normalised text, by backtracking."""
        n = len(text)
        starts: list[list[int]] = [[i + 1] for i in range(n)]  # where the pieces from each place end, ascending
        for end, length in self.automaton.iter(text):
            starts[end - length + 1].append(end + 1)
        pairs, last = self.pairs.get, ""
        path: list[tuple[int, str, int]] = []  # start, piece, and how many shorter ones that place still has
        pos, failed, ends = 0, 0, starts[0]
        tries = len(ends)
        while True:
            while tries:
                tries -= 1
                end = ends[tries]
                if failed >> end & 1:
                    continue
                piece = text[pos:end]
                known = pairs((last, piece))
                if known or (known is None and self._follows(last, piece)):
                    break
            else:
                failed |= 1 << pos
                pos, _, tries = path.pop()
                last, ends = path[-1][1] if path else "", starts[pos]
                continue
            path.append((pos, piece, tries))
            if end == n:
                return [x[1] for x in path]
            pos, last, ends = end, piece, starts[end]
            tries = len(ends)

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal with a space after each, decoded text) of one chunk; two generations are cached."""
        if (found := self.young.get(chunk)) is None:
            if (found := self.old.get(chunk)) is None:
                ids = self._chunk_ids(chunk)
                found = len(ids), "".join([f"{i} " for i in ids]), self._surface(ids)
            if len(chunk) <= 64:
                if len(self.young) >= self.limit:
                    self.old = dict(self.young)
                    self.young.clear()  # the same dictionary, for those who hold it
                self.young[chunk] = found
        return found

    def _chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self._parts(chunk):
            if (ids := self.parts.get(part)) is None:
                ids = tuple(self._ids(self.split(part)))
                if len(part) <= 64:
                    if len(self.parts) >= self.limit:
                        self.parts.clear()
                    self.parts[part] = ids
            out += ids
        return out

    def _parts(self, chunk: str) -> list[str]:
        """The chunk, cut between characters that are neighbours in no piece."""
        near = self.neighbours
        if all([x in near for x in zip(chunk, chunk[1:])]):  # noqa: B905
            return [chunk]
        cuts = [i for i in range(1, len(chunk)) if (chunk[i - 1], chunk[i]) not in near]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can span."""
        if not text:
            return []
        return self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str, eos: bool = True) -> list[int]:
        return [i for c in self.chunks(text) for i in self._chunk_ids(c)] + [self.eos] * eos

    def both_ways(self, text: str, eos: bool = True) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by one space, decoded text): encode and decode, with chunks from the cache."""
        known, other = self.young.get, self._chunk
        found = [known(c) or other(c) for c in self.chunks(text)]
        joined = "".join([x[1] for x in found]) + f"{self.eos} " * eos
        decoded = "".join([x[2] for x in found])
        return sum([x[0] for x in found]) + eos, joined[:-1], decoded[1:] if self._drops_first(decoded) else decoded

    def decode(self, ids: list[int]) -> str:
        out = self._surface(ids)
        return out[1:] if self._drops_first(out) and self.kinds[next(i for i in ids if self.kinds[i] not in (2, 3) or i == self.unk)] == _NORMAL else out

    def _drops_first(self, surface: str) -> bool:
        """The space that stands before every text."""
        return self.prefix and surface.startswith(" ")

    def _surface(self, ids: list[int]) -> str:
        if self.shown.issuperset(ids):
            return "".join([self.shown_as[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == _BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind == _NORMAL:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif i == self.unk:
                out.append(self.unk_surface)
        return "".join(out) + _utf8(bytes(held))


def _utf8(raw: bytes) -> str:
    """UTF-8, each byte that is not part of a code point as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as bad:
        return raw[: bad.start].decode() + "�" + _utf8(raw[bad.start + 1 :])


_codecs: dict[str, MergeCodec] = {}


def codec(proto: bytes) -> MergeCodec:
    """One codec a worker process and model."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _codecs:
        _codecs[key] = MergeCodec(proto)
    return _codecs[key]


def encode_documents(docs: DataFrame, proto: bytes, *, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens (all ids), ids_sha256, decoded_sha256; with_ids: ids and decoded as well.

    An end id and no begin id. Null counts as empty: its one id is the end. Repeated rows and ids are encoded each on its
    own; an empty table gives no rows; other columns are not read. A text of any length is whole in one row's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(proto)
        own.forget()  # a task that broke off may have left its caches
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, ids_sha, decoded_sha, all_ids, all_decoded = [], [], [], [], []
                for value in part.column(1).to_pylist():
                    count, joined, decoded = own.both_ways(value or "")
                    n.append(count)
                    ids_sha.append(sha(joined))
                    decoded_sha.append(sha(decoded))
                    if with_ids:
                        all_ids.append(np.array(joined.split(" "), np.int32))
                        all_decoded.append(decoded)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
        own.forget()

    def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """run, without searches for cycles among the caches' many tuples, which have none."""
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(trimmed(uncollected), schema)
