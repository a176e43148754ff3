"""Packing of documents into sequences of bounded length by Karmarkar-Karp multiway differencing.

A document's ids are cut where a sequence would be full, and the rest into short pieces; pieces that fill a sequence stand
alone. The others are dealt by hash into groups of bounded size, and each group is split over windows: every piece starts as a partial partition of its own,
the two partial partitions of the largest spread are merged, the fullest window of one with the emptiest of the other,
until one is left. Where its fullest window passes the capacity, the group is split anew over one window more.

Texts are read once and never shuffled; ids wait in the shared folder, and only lengths go to the groups.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import trimmed, whole_groups, written

#: Words whose ids a task keeps: two generations of this many.
CACHED_WORDS = 1 << 19
#: Python's white space that the tokenizer's pattern does not take for white space.
_NO_BREAK = re.compile("[\x1c-\x1f]")
#: Letters that every rule of Unicode takes alike, and a mark that is a token of its own.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch
#: Bits of a sequence id for the window in its group.
_WINDOW_BITS = 20
#: Bytes of ids in a batch that a task gives back.
_OUT_BYTES = 16 << 20


def _kinds(rules: dict, step: str) -> list[str]:
    """The kinds of a tokenizer's rules of one step, where they are a sequence."""
    own = rules.get(step) or {}
    return [rule["type"] for rule in own.get("normalizers" if step == "normalizer" else "pretokenizers", [])]


class Words:
    """Ids of a text, as bytes of little-endian 32-bit ids, by way of its words.

    The tokenizer's rules never reach over white space, so a text's ids are its words' ids in a row; each word is given
    to the tokenizer once and then kept, in two generations, so memory is bounded. A text that holds one of the four
    separators that only Python takes for white space goes to the tokenizer whole. Where the tokenizer's rules are NFC,
    white space, lower case, runs of letters and bytes, as in the public one, a plain word is its letters in lower case and
    maybe a mark of its own: the letters, which more words share, then go to the same merges without those rules.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.spec = spec
        self.tokenizer, self.bare = Tokenizer.from_str(spec), None
        rules = json.loads(spec)
        if [_kinds(rules, "normalizer"), _kinds(rules, "pre_tokenizer")] == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            last = rules["pre_tokenizer"]["pretokenizers"][-1]
            self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": last, "added_tokens": []}))
        self.marks = dict(zip(["", ".", ","], [b"", *self._encoded(self.tokenizer, [".", ","])]))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _encoded(tokenizer, texts: list[str]) -> list[bytes]:
        found = []
        for lo in range(0, len(texts), 4096):
            found += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
        return found

    def _learn(self, words: set[str]) -> None:
        odd, plain, cores = [], [], set()
        for word in words:
            if (kept := self.old.get(word)) is not None:
                self.young[word] = kept
            elif self.bare and (found := _PLAIN(word)):
                plain.append((word, core := found[1].lower(), found[2]))
                if core not in self.young:
                    if (kept := self.old.get(core)) is not None:
                        self.young[core] = kept
                    else:
                        cores.add(core)
            else:
                odd.append(word)
        for tokenizer, new in ((self.tokenizer, odd), (self.bare, list(cores))):
            self.young.update(zip(new, self._encoded(tokenizer, new)))
        self.young.update((word, self.young[core] + self.marks[mark]) for word, core, mark in plain)

    def ids(self, text: str) -> bytes:
        if _NO_BREAK.search(text):
            return self._encoded(self.tokenizer, [text])[0]
        words = text.split()
        if new := set(words).difference(self.young):
            if len(self.young) + 2 * len(new) > CACHED_WORDS:
                self.old, self.young = self.young, {}
                new = set(words)
            self._learn(new)
        return b"".join(map(self.young.__getitem__, words))


_words: Words | None = None


def _worker_words(spec: str) -> Words:
    """The words that this worker's earlier tasks met serve its later ones."""
    global _words
    if _words is None or _words.spec != spec:
        _words = Words(spec)
    return _words


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Where the pieces of n ids end: full sequences first, then even parts of at most `piece` ids."""
    full, rest = divmod(n, capacity)
    parts = -(-rest // piece)
    return [capacity * (i + 1) for i in range(full)] + [capacity * full + rest * (i + 1) // parts for i in range(parts)]


def _pieces(spec: str, end_id: int, capacity: int, most: int):
    """For mapInArrow: (row, doc_id, text) to the pieces of each text's ids and end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _worker_words(spec), np.array([end_id], "<u4").tobytes()
        kinds = {"at": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}

        def made(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
            at, *own = (pa.array(values, kind) for values, kind in zip(zip(*out), kinds.values()))
            return pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), *own], ["row", "doc_id", *list(kinds)[1:]])

        for batch in batches:
            out, held = [], 0
            for n, text in enumerate(batch.column("text")):
                ids = words.ids(text.as_py() or "") + end
                at = 0
                for stop in cuts(len(ids) // 4, capacity, most):
                    piece = ids[4 * at : 4 * stop]
                    out.append((n, at, stop - at, piece, zlib.crc32(piece), len(ids) // 4))
                    at = stop
                    held += len(piece)
                    if held > _OUT_BYTES:
                        yield made(out, batch)
                        out, held = [], 0
            if out:
                yield made(out, batch)

    return trimmed(run)


def _merged(a: tuple[np.ndarray, list], b: tuple[np.ndarray, list], windows: int) -> tuple[np.ndarray, list]:
    """Two partial partitions as one, the fullest window of one with the emptiest of the other."""
    (sums, trees), (others, their) = a, b
    if (empty := windows - len(sums) - len(others)) >= 0:
        both, joined = np.concatenate([sums, others]), trees + their
    else:
        both = np.zeros(windows, np.int64)
        both[: len(sums)] = sums
        both[windows - len(others) :] += others[::-1]
        alone = windows - len(others)  # from here on both have a window, up to the end of the first's
        joined = trees[:alone] + [(x, y) for x, y in zip(trees[alone:], reversed(their))] + their[: len(others) - (len(sums) - alone)][::-1]
    place = np.argsort(-both, kind="stable")
    both = both[place]
    return (both - both[-1] if empty <= 0 else both), [joined[p] for p in place.tolist()]


def differenced(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Each length's window, 0 to windows - 1, by multiway differencing.

    A partial partition is the sums of its windows, descending, less the least of them, with what lies in each; windows
    without anything are left out, so memory grows with the lengths alone. Of equal spreads the one made first is taken
    first, so the result is the same wherever it runs.
    """
    found = np.zeros(len(lengths), np.int64)
    if windows == 1 or not len(lengths):
        return found
    held: list[tuple[np.ndarray, list] | None] = [(lengths[i : i + 1].astype(np.int64), [int(i)]) for i in np.argsort(-lengths, kind="stable")]
    heap = [(-int(sums[0]), n) for n, (sums, _) in enumerate(held)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        held.append(_merged(held[a], held[b], windows))
        held[a] = held[b] = None
        heapq.heappush(heap, (-int(held[-1][0][0]), len(held) - 1))
    for window, tree in enumerate(held[heap[0][1]][1]):
        open_ = [tree]
        while open_:
            node = open_.pop()
            if isinstance(node, tuple):
                open_ += node
            else:
                found[node] = window
    return found


def windows_for(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Windows by differencing over as few windows as the sum allows, and one more as often as the fullest passes the capacity."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        found = differenced(lengths, windows)
        if np.bincount(found, lengths, windows).max(initial=0) <= capacity:
            return found
        windows += 1


def _packed(capacity: int):
    """For mapInArrow: whole groups of (group, row, start, length) to (row, start, sequence_id, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "group"):
            groups = rows.column("group").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = rows.slice(lo, hi - lo)
                lengths = own.column("length").to_numpy()
                window = windows_for(lengths, capacity)
                order = np.argsort(window, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], window[order][1:] != window[order][:-1]])
                offset = np.empty(len(window), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                arrays = [*(own.column(c).combine_chunks() for c in ("row", "start")), pa.array((groups[lo] << _WINDOW_BITS) + window), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "start", "sequence_id", "offset"])

    return trimmed(run)


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 4096, piece: int = 1024, group_windows: int = 128) -> DataFrame:
    """One row a piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: the JSON of a `tokenizers` tokenizer whose rules never reach over white space. A document is its ids and
    end_id; ids are bytes of little-endian unsigned 32-bit ids. What is left of a document after full sequences is cut into
    even parts of at most `piece` ids, as shorter pieces leave less padding. Null text counts as empty, which is the end id alone. A
    piece that fills a sequence has a sequence of its own, with a negative id; others share one with offsets that have no
    gap. Repeated rows and ids, and null ids, are documents each; an empty table gives no pieces. Other columns are not read.

    Groups are of about `group_windows` sequences and follow from a hash of the row, so no key can be hot; each wastes a
    sequence or two. ids stay in the shared folder unless the result's `ids` are asked for.
    """
    if not 0 < piece <= capacity <= 1 << 24:
        raise ValueError("a capacity between 1 and 2**24, and pieces of at most that")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, ids_crc32 long, doc_tokens long"
    pieces = written(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, piece), schema), "pieces")
    loose = pieces.filter(F.col("length") < capacity).select("row", "start", "length")
    total = loose.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_windows)))
    dealt = loose.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    schema = "row long, start long, sequence_id long, offset long"
    windows = dealt.repartition("group").sortWithinPartitions("group", "row", "start").mapInArrow(_packed(capacity), schema)
    full = pieces.filter(F.col("length") == capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    shared = pieces.filter(F.col("length") < capacity).join(windows, ["row", "start"])
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*names).unionByName(shared.select(*names))


def sequences(pieces: DataFrame, *, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, length, ids: each sequence's ids as bytes, filled with pad_id to `capacity` unless its length is a power of two.

    A sequence's pieces are at most `capacity` ids, so no group is large.
    """
    bits = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), bits.alias("bits"))
    joined = F.aggregate("bits", F.lit(b"").cast("binary"), lambda so_far, bit: F.concat(so_far, bit["ids"]))
    fill = F.when(F.bit_count("length") == 1, 0).otherwise(F.lit(capacity) - F.col("length")).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), fill))
    return whole.select("sequence_id", "length", F.concat(joined, pad).alias("ids"))
