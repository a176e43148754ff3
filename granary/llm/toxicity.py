"""Toxicity: a logistic classifier whose scores must not change when identity terms are swapped.

Features are a text's distinct words and word beginnings, by hash. Those that tell the labels apart are chosen by their
chi-squared. In training, each labelled text that has identity terms is paired with copies in which they are swapped
for others of their group; the squared difference of the pair's logits is part of the loss, so that a neutral mention of
a group does not raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ALNUM, Spans, text_slabs, words, written

#: Identity terms by group; each may stand for another of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab", "chinese", "mexican"), ("immigrant", "native"), ("immigrants", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("musulmans", "chrétiens", "juifs"),
)
PREFIXES = (4, 5)
#: What cross-validation tries: numbers of features, far below those that come to the driver, as these were ranked with all folds; and ridges.
COUNTS, RIDGES = (50, 100, 200, 400), (2e-4, 2e-3, 2e-2)


@dataclass
class Toxicity:
    """Sorted feature hashes, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.features, feature), max(0, len(self.features) - 1))
        hit = self.features[at] == feature if len(self.features) else np.zeros(len(feature), bool)
        pair = np.unique(np.stack([row[hit], at[hit]], axis=1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
        z = self.bias + np.bincount(pair[:, 0], self.weights[pair[:, 1]], rows)
        return 1 / (1 + np.exp(-z))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of each word and word beginning; texts are in lower case. A beginning's hash is not a word's."""
    starts, ends, first = words(data, offsets, ALNUM)
    spans = Spans(data)
    row = np.searchsorted(first[1:], np.arange(len(starts)), "right")
    rows, hashes = [row], [spans.hash(starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        hashes.append(spans.hash(starts[long], starts[long] + n) + np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def _hash_words(terms: Sequence[str]) -> list[list[int]]:
    """Of each term: the features of a text that is just this term."""
    raw = [t.lower().encode() for t in terms]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    row, feature = features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [feature[row == i].tolist() for i in range(len(terms))]


def fit(texts: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, *, identity: Sequence[Sequence[str]] = IDENTITY, fairness: float = 1.0, ridge: float = 2e-3, steps: int = 400, rate: float = 0.1, toxic_weight: float = 3.0) -> Toxicity:
    """Full-batch Adam on log loss (a toxic text counts `toxic_weight` times) + ridge + fairness * mean squared logit change under swaps.

    texts: each text's distinct feature hashes (identity terms' included); chosen: the features with weights.
    """
    groups = [_hash_words(g) for g in identity]
    named = {f[0]: (g, i) for g, terms in enumerate(groups) for i, f in enumerate(terms)}
    all_features = np.unique(np.concatenate([chosen.astype(np.uint64), np.array([f for g in groups for t in g for f in t], np.uint64)]))
    place = {int(f): i for i, f in enumerate(all_features)}
    row, col = [], []
    swap_row, swap_col, swap_sign, swaps = [], [], [], 0
    for r, own in enumerate(texts):
        own = {int(x) for x in own}
        at = [place[f] for f in own if f in place]
        row += [r] * len(at)
        col += at
        terms = [named[f] for f in own if f in named]
        for shift in range(1, 3):  # every term to the next of its group, then to the one after
            if not terms:
                break
            gone = {f for g, i in terms for f in groups[g][i]}
            came = {f for g, i in terms for f in groups[g][(i + shift) % len(groups[g])]}
            change = [(place[f], -1.0) for f in (gone - came) & own] + [(place[f], 1.0) for f in came - gone - own]
            swap_row += [swaps] * len(change)
            swap_col += [c for c, _ in change]
            swap_sign += [s for _, s in change]
            swaps += 1
    row, col, y = np.array(row, int), np.array(col, int), labels.astype(float)
    swap_row, swap_col, swap_sign = np.array(swap_row, int), np.array(swap_col, int), np.array(swap_sign, float)

    def swap_pull(w: np.ndarray) -> np.ndarray | float:
        if not swaps:
            return 0.0
        moved = np.bincount(swap_row, w[swap_col] * swap_sign, swaps)
        return 2 * fairness / swaps * np.bincount(swap_col, swap_sign * moved[swap_row], len(all_features))

    w, bias = _descend(row, col, y, len(all_features), ridge, steps, rate, toxic_weight, swap_pull)
    return Toxicity(all_features, w, bias)


def _descend(row: np.ndarray, col: np.ndarray, y: np.ndarray, k: int, ridge: float, steps: int, rate: float, toxic_weight: float, pull=lambda w: 0.0) -> tuple[np.ndarray, float]:
    """Weights of k features and the bias, from (text, feature) pairs; `pull` is a further gradient of the weights."""
    n = max(1, len(y))
    share = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    w, m, s = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(share / (1 - share))
    for step in range(1, steps + 1 if len(y) else 1):
        z = w[k] + np.bincount(row, w[col], n)
        off = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, toxic_weight, 1.0)
        g = np.append(np.bincount(col, off[row], k) / n + ridge * w[:k], off.mean())
        g[:k] += pull(w[:k])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w[:k], float(w[k])


def _chi(row: np.ndarray, col: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Chi-squared of each of k features with the labels, -1 for those in fewer than four texts."""
    n, pos = len(y), y.sum()
    a, all_ = np.bincount(col, y[row], k), np.bincount(col, minlength=k)
    b = all_ - a
    return np.where(all_ >= 4, (a * (n - pos) - b * pos) ** 2 / (all_ * (n - all_) + 1), -1.0)


def cross_validated(texts: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, *, folds: int = 4, steps: int = 150, rate: float = 0.1, toxic_weight: float = 3.0) -> tuple[int, float]:
    """How many features, and the ridge, with the fewest errors on training texts held out in turn; then the least log loss.

    Texts come sorted by label, so each fold has its share of both. Features are ranked anew without the fold.
    """
    place = {int(f): i for i, f in enumerate(chosen)}
    own = [[place[int(f)] for f in text if int(f) in place] for text in texts]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col, y = np.array([i for x in own for i in x], int), labels.astype(float)
    fold = np.arange(len(y)) % folds
    found: dict[tuple[int, float], list[float]] = {}
    for f in range(folds):
        apart = fold == f
        inside = ~apart[row]
        number = np.cumsum(~apart) - 1
        rank = np.argsort(np.argsort(-_chi(number[row[inside]], col[inside], y[~apart], len(chosen)), kind="stable"), kind="stable")
        for n in sorted({min(n, len(chosen)) for n in COUNTS}):
            low = rank[col] < n
            for ridge in RIDGES:
                w, bias = _descend(number[row[inside & low]], rank[col[inside & low]], y[~apart], n, ridge, steps, rate, toxic_weight)
                out = ~inside & low
                z = bias + np.bincount(row[out], w[rank[col[out]]], len(y))[apart]
                loss = np.logaddexp(0, np.where(y[apart] > 0, -z, z)).sum()
                total = found.setdefault((n, ridge), [0.0, 0.0])
                total[0] += float(((z >= 0) != (y[apart] > 0)).sum())
                total[1] += float(loss)
    return min(found, key=lambda key: (*found[key], key))


def train(labelled: DataFrame, *, max_features: int = 4000, identity: Sequence[Sequence[str]] = IDENTITY, **options) -> Toxicity:
    """Trains on (text, toxic 0/1) rows; the caller bounds their number, as 4000 features of each may come to the driver.

    How many features have weights, and the ridge, are chosen by cross-validation over these rows, unless options name a ridge.
    """
    rows = labelled.filter(F.col("toxic").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slabs(_lower(batch.column(0))):
                row, feature = features(data, offsets)
                pair = np.unique(np.stack([row.astype(np.uint64), feature], axis=1), axis=0)
                count = np.bincount(pair[:, 0].astype(int), minlength=hi - lo)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(pair[:, 1].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), lists], ["toxic", "features"])

    sets = written(rows.mapInArrow(found, "toxic int, features array<long>"), "labelled")  # texts are read once
    n, pos = (int(x or 0) for x in sets.agg(F.count("*"), F.sum("toxic")).first())
    a, b = F.col("a"), F.col("b")  # toxic and other texts that have the feature
    chi = (a * (n - pos) - b * pos) * (a * (n - pos) - b * pos) / ((a + b) * (n - a - b) + 1)
    best = sets.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    chosen = [r["f"] for r in best.filter(a + b >= 4).select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(max_features).collect()]
    wanted = np.array(chosen, np.int64).view(np.uint64)
    terms = np.array([f for g in identity for t in _hash_words(g) for f in t], np.uint64)
    keep = np.sort(np.concatenate([wanted, terms])).view(np.int64).tolist()
    kept = sets.select("toxic", F.array_intersect("features", F.lit(keep) if keep else F.array().cast("array<long>")).alias("features")).collect()
    kept = sorted(((r["toxic"], sorted(r["features"])) for r in kept), key=lambda x: (x[0], x[1]))
    texts, labels = [np.array(x[1], np.int64).view(np.uint64) for x in kept], np.array([x[0] for x in kept])
    if "ridge" not in options and len(wanted) and 0 < labels.sum() < len(labels):
        count, ridge = cross_validated(texts, labels, wanted)
        wanted, options = wanted[:count], options | {"ridge": ridge}
    return fit(texts, labels, wanted, identity=identity, **options)


def bounded_labels(labels: DataFrame, held_out, max_rows: int = 12_000) -> DataFrame:
    """(doc_id, toxic) of the `max_rows` labelled ids of least hash, none of which is held out; a repeated id counts once, toxic if any of its rows is."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def score(docs: DataFrame, model: Toxicity, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score and predicted (1 from 0.5 on) of every whole text.

    Null and empty texts have the bias's score; repeated rows and ids are scored each on its own; an empty table gives
    no rows; columns beside `keep` and the text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes a feature
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [own.scores(*features(data, offsets), hi - lo) for lo, hi, data, offsets in text_slabs(_lower(batch.column(n_keep)))]
            if out:
                z = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(z), pa.array((z >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("text_")).mapInArrow(run, f"{fields}, score double, predicted int")
