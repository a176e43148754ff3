"""Benchmark decontamination: item-sized windows of each text against benchmark items, by edit distance over words.

A window may hold an item only if it shares a short run of words with it and enough of its words altogether; both follow
from the bound on the edits, so neither drops a match. Windows that are left, and all items, are embedded by CGK random
walks, which turn edits into differing places; tables of sampled places bring window and item together; and each pair so
found is verified by the exact edit distance of the item to the best stretch of words about the window.

Of each length of item, walks are added until the tables of random strings and of copies with as many random edits as the
bound allows meet with the target recall; where the most walks allowed do not reach it, windows of that length go to the
exact check without tables. Places past the end of a walk make no key, as all strings look alike there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from granary.llm.common import ALNUM, Spans, mix64, text_slabs, trimmed, words, written

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def cgk(strings: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """(strings, steps) of (strings, n): each step shows the current symbol and moves on if the symbol's coin of this step says so; 0 past the end."""
    count, n = strings.shape
    ended = np.concatenate([strings, np.zeros((count, 1), np.uint64)], axis=1).reshape(-1)
    at = np.arange(count) * (n + 1)
    end = at + n
    out = np.empty((steps, count), np.uint64)
    for step in range(steps):
        if step % 64 == 0:  # one hash of each symbol has the coins of 64 steps
            coins = mix64(ended ^ np.uint64((walk * 100_003 + step // 64 + 1) * int(_STEP) & (2**64 - 1)))
        out[step] = ended[at]
        at = np.minimum(at + (coins[at] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64), end)
    return out.T


def edited(strings: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Copies with so many random edits each (a word changed, left out or put in), cut or filled up with ones to the old length."""
    out = np.ones_like(strings)
    for r, own in enumerate(strings.tolist()):
        for how, new in zip(rng.integers(0, 3, edits), rng.integers(2, 1 << 63, edits).tolist(), strict=True):
            at = int(rng.integers(0, len(own))) if own else 0
            own[at : at + (how != 2)] = [new] if how != 1 else []
        own = own[: strings.shape[1]]
        out[r, : len(own)] = own
    return out


def walks_needed(n: int, edits: int, places: int, samples: int, target: float, most: int, pairs: int = 200) -> int:
    """The fewest walks with whose tables random strings of n words meet their edited copies with the target recall; 0 if `most` of them don't."""
    rng = np.random.default_rng(n)
    strings = rng.integers(2, 1 << 63, (pairs, n)).astype(np.uint64)
    copies, missed = edited(strings, edits, rng), np.ones(pairs)
    for walk in range(most):
        a, b = cgk(strings, walk, 2 * n), cgk(copies, walk, 2 * n)
        missed *= (1 - ((a == b) & (a != 0)).mean(axis=1) ** places) ** samples
        if 1 - missed.mean() >= target:
            return walk + 1
    return 0


def edit_distances(items: np.ndarray, texts: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits from each item to any stretch of its text (anchored: that starts with the text), and where the stretch ends, first of equals."""
    count, m = texts.shape
    place = np.arange(m + 1)
    row = np.tile(place if anchored else np.zeros(m + 1, np.int64), (count, 1))
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - place, axis=1) + place
    end = row.argmin(axis=1)
    return row[np.arange(count), end], end


def _chunks(width: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Places of rows, by their width, in runs whose number times greatest width is at most `most`; one row at least."""
    order = np.argsort(width, kind="stable")
    lo = 0
    while lo < len(order):
        size = np.maximum(1, width[order[lo:]]) * np.arange(1, len(order) - lo + 1)
        hi = lo + max(1, int(np.searchsorted(size, most, "right")))
        yield order[lo:hi]
        lo = hi


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places lo[i] to hi[i], and how many there are of each i."""
    count = hi - lo
    return np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum()), count


@dataclass
class Benchmark:
    """Distinct items as word hashes, and what finds them: anchors, words held, and tables of sampled places.

    ids: those of the items in order, `copies` of each. Memory is in proportion to the items' words and number of tables.
    Items whose length needs more than `most_walks` walks for the target recall have no tables and lose nothing by it.
    """

    ids: pa.Array
    copies: np.ndarray
    items: list[np.ndarray]
    similarity: float = 0.8
    target_recall: float = 0.998
    places: int = 2
    samples: int = 12
    most_walks: int = 64
    seed: int = 5
    vocabulary: np.ndarray = field(init=False)

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.copies)]).astype(np.int64)
        self.length = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.floor(self.length * (1 - self.similarity) + 1e-9).astype(np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.items]))
        own = [np.searchsorted(self.vocabulary, x) for x in self.items]
        self.held = np.zeros(1 << int(16 * max(1, self.length.sum())).bit_length(), bool)
        for i, x in enumerate(own):
            self.held[self._place(np.full(len(x), i), x)] = True
        # Of n words with k edits, n - k stay in at most k + 1 runs, so one run has at least this many; three are enough.
        run = np.minimum(3, -(-(self.length - self.edits) // (self.edits + 1)))
        self.anchors = {}
        for size in sorted(set(run.tolist())):
            found = [(self._gram(x, size)[j], i, j) for i, x in enumerate(own) if run[i] == size for j in range(len(x) - size + 1)]
            order = sorted(found)
            self.anchors[size] = tuple(np.array([x[c] for x in order], np.int64) for c in range(3))
        rng = np.random.default_rng(self.seed)
        self.picks, walks = {}, {}
        for n in sorted(set(self.length.tolist())):
            near = max(n, int(np.ceil(1.2 ** np.ceil(np.log(n) / np.log(1.2)))))  # lengths up to a fifth apart are measured once
            if near not in walks:
                walks[near] = walks_needed(near, int(near * (1 - self.similarity) + 1e-9), self.places, self.samples, self.target_recall, self.most_walks)
            self.picks[n] = rng.integers(0, 2 * n, (walks[near], self.samples, self.places))
        keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in (n for n in self.picks if len(self.picks[n])):
            which = np.flatnonzero(self.length == n)
            for key, ok in self._keys(np.stack([self.items[i] for i in which]), n):
                keys.append(key[ok])
                at.append(which[ok])
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def _place(self, item: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where `held` says that the item has the word; for a few other words it says so too, which only lets a window pass."""
        return (mix64(item.astype(np.uint64) * _STEP + code.astype(np.uint64)) & np.uint64(len(self.held) - 1)).astype(np.int64)

    def _gram(self, codes: np.ndarray, size: int) -> np.ndarray:
        base, out = len(self.vocabulary) + 1, np.zeros(max(0, len(codes) - size + 1), np.int64)
        for j in range(size):
            out = out * base + codes[j : len(codes) - size + 1 + j]
        return out

    def _keys(self, strings: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The key of each string in each table, a mix of the table and of the sampled places of one walk, and whether it has one."""
        for walk, tables in enumerate(self.picks[n]):
            embedded = cgk(strings, walk, 2 * n)
            for sample, picked in enumerate(tables):
                key, ok = np.full(len(strings), (n * 1000 + walk) * 1000 + sample, np.uint64), np.ones(len(strings), bool)
                for place in picked:
                    key = key * _STEP + embedded[:, place]
                    ok &= embedded[:, place] != 0
                yield mix64(key), ok

    def find(self, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """text, distinct item, edits, first word and word after the last, of the best stretch for each text and item that match.

        own: the word hashes of all texts; first: each text's first word.
        """
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(own) or not len(self.items):
            return none
        code = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[code] == own, code, len(self.vocabulary))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        item, row, at = self._anchored(code, text)
        return self._verified(own, first, *self._met(own, first, item, row, at)) if len(item) else none

    def _anchored(self, code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, first word of a window in line with it) for shared runs of words whose surroundings have enough of the item's words."""
        known = code < len(self.vocabulary)
        found = [np.zeros((0, 3), np.int64)]
        for size, (grams, item, offset) in self.anchors.items():
            if len(code) < size:
                continue
            whole = known[: len(code) - size + 1] & (text[: len(code) - size + 1] == text[size - 1 :])
            for j in range(1, size):
                whole &= known[j : len(code) - size + 1 + j]
            place = np.flatnonzero(whole)
            gram = self._gram(code, size)[place]
            k, count = _runs(np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right"))
            found.append(np.stack([item[k], np.repeat(text[place], count), np.repeat(place, count) - offset[k]], axis=1))
        item, row, at = np.unique(np.concatenate(found), axis=0).T
        keep = np.zeros(len(item), bool)
        bound = np.searchsorted(text, np.arange(int(text[-1]) + 2))
        width = self.length[item] + 2 * self.edits[item]
        for part in _chunks(width):
            i, r = item[part], row[part]
            reach = np.arange(int(width[part].max()))
            place = (at[part] - self.edits[i])[:, None] + reach
            inside = (reach < width[part][:, None]) & (place >= bound[r][:, None]) & (place < bound[r + 1][:, None])
            word = code[np.clip(place, 0, len(code) - 1)]
            there = self.held[self._place(i[:, None], word)] & inside & (word < len(self.vocabulary))
            keep[part] = there.sum(axis=1) >= self.length[i] - self.edits[i]
        return item[keep], row[keep], at[keep]

    def _cut(self, own: np.ndarray, first: np.ndarray, row: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """(windows, size) of word hashes from word `at` on; 1 where the text has no word, which no item has."""
        place = at[:, None] + np.arange(size)
        inside = (place >= first[row][:, None]) & (place < first[row + 1][:, None])
        return np.where(inside, own[np.clip(place, 0, len(own) - 1)], np.uint64(1))

    def _met(self, own: np.ndarray, first: np.ndarray, item: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window's first word, item) that share a table's key; windows are of the lengths that anchored them."""
        found = [np.zeros((0, 3), np.int64)]
        for n in np.unique(self.length[item]).tolist():
            which = self.length[item] == n
            if not len(self.picks[n]):
                found.append(np.stack([row, at, item], axis=1)[which])
                continue
            windows = np.unique(np.stack([row, at], axis=1)[which], axis=0)
            for part in _chunks(np.full(len(windows), 2 * n)):
                window = windows[part]
                for key, ok in self._keys(self._cut(own, first, window[:, 0], window[:, 1], n), n):
                    lo = np.searchsorted(self.keys, key)
                    some = np.flatnonzero(ok & (self.keys[np.minimum(lo, len(self.keys) - 1)] == key))
                    if len(some):
                        k, count = _runs(lo[some], np.searchsorted(self.keys, key[some], "right"))
                        found.append(np.concatenate([np.repeat(window[some], count, axis=0), self.at[k][:, None]], axis=1))
                found = [np.unique(np.concatenate(found), axis=0)]
        found = np.unique(np.concatenate(found), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def _verified(self, own, first, row, at, item) -> tuple[np.ndarray, ...]:
        out = [np.zeros((0, 5), np.int64)]
        for n in np.unique(self.length[item]).tolist():
            which = np.flatnonzero(self.length[item] == n)
            e = int(self.edits[item[which[0]]])
            for part in _chunks(np.full(len(which), n + 2 * e)):
                part = which[part]
                r, i = row[part], item[part]
                strings = np.stack([self.items[x] for x in i])
                begin = at[part] - e
                region = self._cut(own, first, r, begin, n + 2 * e)
                edits, end = edit_distances(strings, region)
                ok = edits <= e
                r, i, edits, end, strings, begin = r[ok], i[ok], edits[ok], end[ok], strings[ok], begin[ok]
                back = self._cut(own, first, r, begin + end - (n + 2 * e), n + 2 * e)[:, ::-1]
                _, length = edit_distances(strings[:, ::-1], back, anchored=True)
                last = begin + end
                out.append(np.stack([r, i, edits, last - length - first[r], last - first[r]], axis=1))
        rows = np.concatenate(out)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        best = np.ones(len(rows), bool)
        best[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return tuple(rows[best].T)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and each text's first."""
    starts, ends, first = words(data, offsets, ALNUM)
    return Spans(data).hash(starts, ends), first


def benchmark(items: DataFrame, *, text: str = "text", block_chars: int = 3_000_000, **options) -> list[Benchmark]:
    """The items in blocks of some `block_chars` characters (about 30 MB as tables), each of which is broadcast on its own.

    Items that repeat a text are searched for once and reported each. Items without a word (null and empty ones too) match
    nothing; shorter ones than 1 / (1 - similarity) words, 5 by default, allow no edit and match where all their words
    stand in a row. Ids may be of any type.
    """
    rows = items.select("item_id", F.col(text).alias("text_")).filter(F.length("text_") > 0)
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text_"))).first()[0] or 0) // block_chars))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    rows = written(rows, "items") if blocks > 1 else rows
    kind, out = to_arrow_type(items.schema["item_id"].dataType), []
    for block in range(blocks):
        own = sorted(rows.filter(F.col("block") == block).collect(), key=lambda r: (r["text_"], str(r["item_id"])))
        found: dict[bytes, list] = {}
        for lo, hi, data, offsets in text_slabs(_lower(pa.array([r["text_"] for r in own], pa.string()))):
            hashes, first = word_hashes(data, offsets)
            for i in range(hi - lo):
                if first[i] < first[i + 1]:
                    found.setdefault(hashes[first[i] : first[i + 1]].tobytes(), []).append(own[lo + i]["item_id"])
        ids = pa.array([x for same in found.values() for x in same], kind)
        out.append(Benchmark(ids, np.array([len(x) for x in found.values()], np.int64), [np.frombuffer(x, np.uint64) for x in found], **options))
    return out


def _scans(docs: DataFrame, blocks: list[Benchmark], at_once: int = 4) -> Iterator[list]:
    """The blocks' broadcasts in lists of at most `at_once`, each for one reading of the texts."""
    for lo in range(0, len(blocks), at_once):
        yield [docs.sparkSession.sparkContext.broadcast(block) for block in blocks[lo : lo + at_once]]


def contamination(docs: DataFrame, blocks: list[Benchmark], *, text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, similarity (1 - edits / item's words), first_word, end_word: the best stretch for each text and item that match.

    A match is a stretch of words within (1 - similarity) of the item's words, rounded down, in edits of whole words; words
    are runs of letters and digits in lower case. Null and empty texts match nothing; repeated rows give repeated matches;
    an empty table gives no rows; other columns are not read. Very long texts are searched whole.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), _id_type(blocks)
    names, out = ["doc_id", "item_id", "edits", "similarity", "first_word", "end_word"], None
    for shared in _scans(docs, blocks):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [x.value for x in shared]
            for batch in batches:
                for lo, _, data, offsets in text_slabs(_lower(batch.column(1))):
                    hashes, first = word_hashes(data, offsets)
                    for block in own:
                        row, item, edits, begin, end = block.find(hashes, first)
                        if len(row):
                            which, count = _runs(block.first[item], block.first[item + 1])
                            found = [edits, 1 - edits / block.length[item], begin, end]
                            ids = batch.column(0).take(pa.array(lo + np.repeat(row, count)))
                            yield pa.RecordBatch.from_arrays([ids, block.ids.take(pa.array(which)), *(pa.array(np.repeat(x, count)) for x in found)], names)

        part = docs.select("doc_id", F.col(text).alias("text_")).mapInArrow(trimmed(run), "doc_id {}, item_id {}, edits long, similarity double, first_word long, end_word long".format(*kinds))
        out = part if out is None else out.unionByName(part)
    return out


def _id_type(blocks: list[Benchmark]) -> str:
    return from_arrow_type(blocks[0].ids.type).simpleString()


def decontaminated(docs: DataFrame, blocks: list[Benchmark], *, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text matches no item: decided row by row, with no join."""
    at = docs.columns.index(text)
    for shared in _scans(docs, blocks):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [x.value for x in shared]
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in text_slabs(_lower(batch.column(at))):
                    hashes, first = word_hashes(data, offsets)
                    for block in own:
                        clean[lo + block.find(hashes, first)[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
