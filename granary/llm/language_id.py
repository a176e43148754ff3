"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded; filters of several widths run over a window of fixed length; each filter's greatest answer in the
window goes into a softmax over the languages. A whole text is a row of such windows, and its prediction is the
language with the greatest sum of log-probabilities. For prediction embedding and filters are folded into one table a
place in the filter, so that a convolution is a few row look-ups and sums a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, text_slabs, trimmed

UNDETERMINED = "und"


@dataclass
class ByteConv:
    """A trained network: languages, tables[j] (256 x filters that reach place j), bias, and the softmax layer."""

    languages: list[str]
    window: int
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages) of (windows, bytes)."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        reach = len(self.tables)
        for lo in range(0, len(windows), 64):
            part = windows[lo : lo + 64]
            span = part.shape[1] - reach + 1
            acc = self.tables[0][part[:, :span]]
            for j in range(1, reach):
                table = self.tables[j]
                acc[:, :, acc.shape[2] - table.shape[1] :] += table[part[:, j : j + span]]
            pooled = np.maximum(acc.max(axis=1) + self.bias, 0)
            z = pooled @ self.weights + self.offset
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + 64] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def cut_windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (the last of a text is filled with zeros), the bytes that each has, and each text's first window."""
    size = np.diff(offsets)
    count = -(-size // window)
    first = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], count)
    starts = np.repeat(offsets[:-1], count) + inside * window
    length = np.minimum(np.repeat(offsets[1:], count) - starts, window)
    padded = np.concatenate([LOWER[data], np.zeros(window, np.uint8)])
    out = padded[starts[:, None] + np.arange(window)]
    out[np.arange(window) >= length[:, None]] = 0
    return out, length, first


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, widths=(2, 3, 4), filters: int = 16, dim: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 7) -> ByteConv:
    """Trains on windows (n, bytes) with labels (n) by Adam; the seed alone decides the order and the start."""
    rng = np.random.default_rng(seed)
    k, window = len(languages), windows.shape[1]
    p = {"e": rng.normal(0, 0.5, (256, dim))} | {f"w{w}": rng.normal(0, (w * dim) ** -0.5, (w * dim, filters)) for w in widths}
    p |= {"b": np.zeros(filters * len(widths)), "v": rng.normal(0, 0.1, (filters * len(widths), k)), "c": np.zeros(k)}
    p = {n: x.astype(np.float32) for n, x in p.items()}
    m, s, step = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0
    reach = max(widths)
    span = window - reach + 1
    for _ in range(epochs if len(windows) else 0):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            x, y = windows[order[lo : lo + batch]], labels[order[lo : lo + batch]]
            n = np.arange(len(x))
            e = p["e"][x]
            at, patches, answers = {}, {}, []
            for w in widths:
                z = sum(e[:, j : j + span] @ p[f"w{w}"][j * dim : (j + 1) * dim] for j in range(w))
                at[w] = z.argmax(axis=1)
                answers.append(np.take_along_axis(z, at[w][:, None], 1)[:, 0])
            raw = np.concatenate(answers, axis=1) + p["b"]
            pooled = np.maximum(raw, 0)
            z = pooled @ p["v"] + p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[n, y] -= 1
            z /= len(x)
            g = {"v": pooled.T @ z, "c": z.sum(0), "e": np.zeros_like(p["e"])}
            back = (z @ p["v"].T) * (raw > 0)
            g["b"] = back.sum(0)
            for i, w in enumerate(widths):
                own = back[:, i * filters : (i + 1) * filters]
                here = at[w][:, :, None] + np.arange(w)
                bytes_at = x[n[:, None, None], here]
                patches = p["e"][bytes_at].reshape(len(x), filters, w * dim)
                g[f"w{w}"] = np.einsum("bfi,bf->if", patches, own)
                down = (own[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, dim)
                np.add.at(g["e"], bytes_at.reshape(-1), down)
            step += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                s[name] = 0.999 * s[name] + 0.001 * g[name] ** 2
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return folded(p, languages, window)


def folded(p: dict[str, np.ndarray], languages: list[str], window: int) -> ByteConv:
    """The network of these parameters, with embedding and filters as one table a place: e (256, dim), w2, w3, ... (width * dim, filters), b, v, c."""
    widths, dim = sorted(int(name[1:]) for name in p if name[0] == "w"), p["e"].shape[1]
    tables = [np.concatenate([p["e"] @ p[f"w{w}"][j * dim : (j + 1) * dim] for w in widths if w > j], axis=1).astype(np.float32) for j in range(widths[-1])]
    return ByteConv(languages, window, tables, p["b"], p["v"], p["c"])


def train(rows: DataFrame, *, max_docs: int = 6000, windows_per_doc: int = 4, window: int = 256, **options) -> ByteConv:
    """Trains on (doc_id, text, lang) rows with a lang: on all ids, or on the `max_docs` ids of least hash where there are more.

    Of such a text at most `windows_per_doc` windows, spread evenly from its start to its end, go to the driver: at most
    max_docs * windows_per_doc * window bytes (6 MB by default), whatever the table's size. Rows that repeat an id count
    once, by the least of their languages and windows. Null and empty texts have no windows. Ids alone are read to choose.
    """
    rows = rows.filter(F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    least = rows.select("h").distinct().orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in text_slabs(batch.column(0)):
                for i in range(len(offsets) - 1):
                    size = int(offsets[i + 1] - offsets[i])
                    n = min(windows_per_doc, -(-size // window))
                    starts = np.linspace(0, max(0, size - window), n).astype(int)
                    found.append([LOWER[data[offsets[i] + at : min(offsets[i] + at + window, offsets[i + 1])]].tobytes().ljust(window, b"\0") for at in starts])
            columns = [batch.column(2), batch.column(1), pa.array(found, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "windows"])

    found = []
    if least is not None:
        some = rows.filter(F.col("h") <= least).select("text", "lang", "h").mapInArrow(cut, "h long, lang string, windows array<binary>")
        one = some.filter(F.size("windows") > 0).groupBy("h").agg(F.min(F.struct("lang", "windows")).alias("one")).select("one.*")
        found = [(r["lang"], w) for r in one.collect() for w in r["windows"]]
    found = sorted((lang, bytes(w)) for lang, w in found)  # so that the order in which tasks end decides nothing
    languages = sorted({x[0] for x in found})
    data = np.frombuffer(b"".join(x[1] for x in found), np.uint8).reshape(-1, window)
    labels = np.searchsorted(languages, [x[0] for x in found]) if found else np.zeros(0, int)
    return fit(data, labels, languages, **options)


def text_languages(model: ByteConv, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language by number, and that language's mean probability over the text's bytes."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi, data, offsets in text_slabs(texts, 1 << 19) if model.languages else ():
        windows, length, first = cut_windows(data, offsets, model.window)
        logs = model.log_probabilities(windows)
        share = length[:, None].astype(np.float64)
        sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs * share, axis=0)])
        odds = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(np.exp(logs) * share, axis=0)])
        best[lo:hi] = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)
        mean = (odds[first[1:]] - odds[first[:-1]]) / np.maximum(1, np.diff(offsets))[:, None]
        score[lo:hi] = np.clip(mean[np.arange(hi - lo), best[lo:hi]], 0, 1)
    return best, score


def predict(docs: DataFrame, model: ByteConv, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred and score: the mean over the text's bytes of the predicted language's probability in its window.

    A text that is null or has no letter is "und" with score 0, as is any text where no language was learned. Every byte
    of a text of any length is in one window; repeated rows and ids are predicted each on its own; an empty table gives
    no rows; columns beside `keep` and the text are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some 150 KB, as its shapes are parameters
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = np.asarray(batch.column(n_keep + 1)).astype(bool) if own.languages else np.zeros(batch.num_rows, bool)
            best, score = text_languages(own, batch.column(n_keep))
            names = pa.array([*own.languages, UNDETERMINED], pa.string()).take(pa.array(np.where(letters, best, len(own.languages))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], names, pa.array(np.where(letters, score, 0.0))], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    return docs.select(*keep, F.col(text).alias("text_"), has_letter).mapInArrow(trimmed(run), f"{fields}, lang_pred string, score double")


def identified(docs: DataFrame, model: ByteConv, *, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that predict() gives a language, whatever its score; "und" rows go. Decided row by row, with no join."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    marked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))  # names cannot clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            letters = np.asarray(batch.column(1)).astype(bool) if own.languages else np.zeros(batch.num_rows, bool)
            best, _ = text_languages(own, rows.column(at))
            yield rows.filter(pa.array(np.where(letters, best, len(own.languages)) < len(own.languages)))

    return marked.mapInArrow(trimmed(run), docs.schema)
