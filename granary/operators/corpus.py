"""From documents to framed tokens, global offsets, prefixes, shards and blocks.

Order is a column: documents are in order of doc_id, tokens of their position. A document's ids stay one binary value of
16-bit ids, cut by slices; tokens are never exploded to rows. Offsets come from sizes alone; texts are shuffled once, to
the run of the stream that they are part of, whose ids are written in order; whole blocks are cut from them as they are
read, and only what lies at a run's ends moves again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import is_blank, strip, word_count
from granary.functions.tokenizer import check, framed_steps, framed_tokens, raw_array, raw_ids, steps, token_measures, with_ids
from granary.operators.ordered import at_starts, binned, last_mark, overlaps, running_total
from granary.sources.files import written

#: Bytes of text that a run of the stream should have.
RUN_BYTES = 64 << 20


def nonblank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(~is_blank(F.col(text)))


def document_counts(docs: DataFrame) -> DataFrame:
    """documents_seen counts every row, documents_written those with text."""
    return docs.agg(F.count("*").alias("documents_seen"), F.count_if(~is_blank(F.col("text"))).alias("documents_written"))


def framed_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, ids: stripped text by the byte tokenizer, with a begin and an end id; blank documents go."""
    return with_ids(framed_tokens(docs))


def token_sizes(docs: DataFrame, proto: bytes | None = None) -> DataFrame:
    """doc_id, n_bytes (of the stripped text), n_tokens (framed) of documents with text."""
    n_bytes = F.octet_length(strip(F.col("text"))).cast("long")
    if not proto:
        return nonblank(docs).select("doc_id", n_bytes.alias("n_bytes"), (n_bytes + 2).alias("n_tokens"))
    check(proto)
    rows = nonblank(docs).select("doc_id", n_bytes.alias("n_bytes"), strip(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw in framed_steps(batch.column(2), proto):
                n = pa.array(np.diff(raw_ids(raw)[1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), n], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def token_offsets(docs: DataFrame, proto: bytes | None = None, runs: int | None = None) -> DataFrame:
    """doc_id, n_tokens (framed), start_pos; texts are read once for their sizes, and sizes alone are ordered."""
    return running_total(token_sizes(docs, proto), ["doc_id", "n_bytes"], "n_tokens", "start_pos", runs).select("doc_id", "n_tokens", "start_pos")


def token_stream(docs: DataFrame, proto: bytes | None = None, runs: int | None = None) -> DataFrame:
    """doc_id, start_pos, n_tokens, raw, in order of doc_id, of any type that sorts; of repeated ids the shorter text comes first.

    Texts are range-partitioned once, into runs of about RUN_BYTES, and tokenized in order; the stream lies in the shared
    folder, a file a run, so what is built on it reads ids and never texts again.
    """
    if proto:
        check(proto)
    rows = nonblank(docs).select("doc_id", strip(F.col("text")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    if runs is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        runs = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RUN_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for lo, hi, raw in framed_steps(batch.column("text"), proto):
                n = np.diff(raw_ids(raw)[1]).astype(np.int64)
                ends = total + np.cumsum(n)
                total = int(ends[-1])
                own = (batch.column(c).slice(lo, hi - lo) for c in ("run", "doc_id"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(ends - n), pa.array(n), raw], ["run", "doc_id", "start_pos", "n_tokens", "raw"])

    ordered = rows.repartitionByRange(runs, "doc_id", "n_bytes").sortWithinPartitions("doc_id", "n_bytes", "text").withColumn("run", F.spark_partition_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    stream = written(ordered.select("run", "doc_id", "text").mapInArrow(run, f"run int, doc_id {kind}, start_pos long, n_tokens long, raw binary"), "stream")
    return at_starts(stream, "run", "start_pos", "n_tokens").select("doc_id", "start_pos", "n_tokens", "raw")


def prefix(stream: DataFrame, target: int) -> DataFrame:
    """The first `target` tokens: documents that start before the target, the last one cut."""
    take = F.least(F.col("n_tokens"), F.lit(target) - F.col("start_pos"))
    rows = stream.filter(F.col("start_pos") < target).withColumn("take", take.cast("long"))
    if "raw" not in stream.columns:
        return rows
    return rows.withColumn("raw", F.substring("raw", F.lit(1), (2 * F.col("take")).cast("int"))).withColumn("n_tokens", F.col("take")).drop("take")


def prefix_report(docs: DataFrame, target: int) -> DataFrame:
    """Of the prefix: its tokens, documents seen (blank ones too) and used when the target is reached, and whether it ends with a document."""
    offsets = token_offsets(docs)
    used = prefix(offsets, target)
    last = used.agg(F.max("doc_id").alias("last_doc"), F.sum("take").cast("long").alias("token_count"), F.count("*").alias("nonempty_documents_seen"), F.max(F.col("start_pos") + F.col("n_tokens")).alias("end"))
    seen = docs.join(F.broadcast(last), F.col("doc_id") <= F.col("last_doc")).agg(F.count("*").alias("documents_seen"))
    whole = F.coalesce(F.col("token_count") == target, F.lit(False))
    return last.crossJoin(seen).select(F.lit(target).cast("long").alias("target"), "token_count", "documents_seen", "nonempty_documents_seen", (F.col("end") == target).alias("ends_at_document_boundary"), whole.alias("complete"))


def _slice(raw: str, first: Column, count: Column) -> Column:
    return F.substring(raw, (2 * first + 1).cast("int"), (2 * count).cast("int"))


def joined(rows: DataFrame, *keys: str) -> DataFrame:
    """The pieces (from_pos, raw) of each key in order of position, as one value; a key's pieces are of fixed size altogether."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("from_pos", "raw"))), lambda p: p["raw"])
    return rows.groupBy(*keys).agg(whole.alias("parts")).select(*keys, F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("raw"))


def _cut(length: int):
    """From a stream in order: whole blocks, and the pieces of blocks that lie at the ends of a run without gaps."""

    def out(number: list[int], at: list[int], pieces: list[np.ndarray], whole: bool) -> pa.RecordBatch:
        begin = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        columns = [pa.array(number, pa.int64()), pa.array(at, pa.int64()), raw_array(np.concatenate(pieces), begin), pa.array([whole] * len(number))]
        return pa.RecordBatch.from_arrays(columns, ["block_id", "from_pos", "raw", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, fresh = np.zeros(0, np.uint16), 0, True  # ids from `at` on; fresh: the block that ends at or after `at` is not written

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, at, fresh
            end = at + len(held)
            first = -(-at // length)
            if fresh and len(held):
                if not last and end < first * length + 1:
                    return
                if first:
                    yield out([first - 1], [at], [held[: first * length + 1 - at]], False)
                fresh = False
            many = max(0, (end - 1 - first * length) // length) if end > first * length else 0
            if many:
                begin = first * length - at
                rows = np.lib.stride_tricks.sliding_window_view(held[begin : begin + many * length + 1], length + 1)[::length]
                number = list(range(first, first + many))
                yield out(number, [b * length for b in number], list(rows), True)
            rest = min((first + many) * length, end)
            if last and rest < end:
                yield out([first + many], [rest], [held[rest - at :]], False)
            held, at = held[rest - at :], rest

        for part in (batch.slice(lo, hi - lo) for batch in batches for lo, hi in steps(batch.column(2))):
            start, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            ids, begin = raw_ids(part.column(2))
            breaks = np.flatnonzero(start[1:] != start[:-1] + n[:-1]) + 1
            for lo, hi in zip([0, *breaks], [*breaks, len(n)], strict=True):
                if start[lo] != at + len(held):
                    yield from cut(True)
                    held, at, fresh = np.zeros(0, np.uint16), int(start[lo]), True
                held = np.concatenate([held, ids[begin[lo] : begin[hi]]])
                yield from cut(False)
        yield from cut(True)

    return run


def blocks(stream: DataFrame, length: int) -> DataFrame:
    """block_id, raw (length + 1 ids): neighbouring blocks share a token; an incomplete last block goes."""
    found = stream.select("start_pos", "n_tokens", "raw").mapInArrow(_cut(length), "block_id long, from_pos long, raw binary, whole boolean")
    edges = joined(found.filter(~F.col("whole")), "block_id").filter(F.octet_length("raw") == 2 * (length + 1))
    return found.filter("whole").select("block_id", "raw").unionByName(edges)


def block_targets(block_rows: DataFrame, length: int) -> DataFrame:
    """block_id, inputs, targets as 16-bit ids."""
    return block_rows.select("block_id", F.substring("raw", F.lit(1), F.lit(2 * length)).alias("inputs"), F.substring("raw", F.lit(3), F.lit(2 * length)).alias("targets"))


def shard_pieces(stream: DataFrame, size: int) -> DataFrame:
    """shard, from_pos, raw: documents, cut where a shard ends. No shard is ever put together in memory."""
    at = F.col("start_pos")
    rows = stream.withColumn("shard", F.explode(F.sequence(F.floor(at / size).cast("long"), F.floor((at + F.col("n_tokens") - 1) / size).cast("long"))))
    lo, hi = F.greatest(at, F.col("shard") * size), F.least(at + F.col("n_tokens"), (F.col("shard") + 1) * size)
    return rows.select("shard", lo.alias("from_pos"), _slice("raw", lo - at, hi - lo).alias("raw"))


def shard_ends(shards: DataFrame) -> DataFrame:
    """Adds first_pos and end_pos to (shard, tokens): where each shard lies in the stream."""
    return running_total(shards, "shard", "tokens", "first_pos").withColumn("end_pos", (F.col("first_pos") + F.col("tokens")).cast("long"))


def located(positions: DataFrame, shards: DataFrame, position: str = "start_pos", runs: int | None = None) -> DataFrame:
    """positions with shard and offset_in_shard, for any number of shards of any sizes; positions past the last shard have null in both.

    Positions and shards' starts are put in one order, and each position takes the last start before it.
    """
    ends = shard_ends(shards).filter("tokens > 0").select("shard", "first_pos", "end_pos")
    found = last_mark(positions, position, ends, "first_pos", runs)
    at = F.col("row")[position]
    inside = at < F.col("mark")["end_pos"]
    return found.select("row.*", F.when(inside, F.col("mark")["shard"]).alias("shard"), F.when(inside, at - F.col("mark")["first_pos"]).alias("offset_in_shard"))


def evaluation_blocks(docs: DataFrame, starts: DataFrame, length: int, proto: bytes | None = None) -> DataFrame:
    """start_token, raw of the length + 1 tokens from each start; starts may overlap and repeat. doc_id names a document.

    Documents and blocks meet by bins of positions, length + 1 wide, so any number of starts is found in proportion to them
    and to the tokens; only documents that a block reaches into are tokenized, and their ids are cut at the bins, so
    that no document, however long, is copied for each of its blocks.
    """
    width = length + 1
    wanted = starts.select(F.col("start_token").cast("long").alias("start_token")).distinct().withColumn("end_token", F.col("start_token") + width)
    offsets = token_offsets(docs, proto).withColumn("end_pos", F.col("start_pos") + F.col("n_tokens"))
    reached = overlaps(offsets, wanted, ("start_pos", "end_pos"), ("start_token", "end_token"), width).select("doc_id", "start_pos", "n_tokens").distinct()
    texts = docs.select("doc_id", "text").join(reached.select("doc_id").distinct(), "doc_id", "left_semi")
    raw = framed_tokens(texts, proto).withColumn("n_tokens", (F.octet_length("raw") / 2).cast("long")).join(reached, ["doc_id", "n_tokens"])
    pieces = shard_pieces(raw, width).withColumnRenamed("shard", "bin")
    begin, end = F.greatest("from_pos", "start_token"), F.least(F.col("from_pos") + F.octet_length("raw") / 2, F.col("end_token")).cast("long")
    found = binned(wanted, "start_token", "end_token", width, "bin").join(pieces, "bin").filter(begin < end)
    found = found.select("start_token", begin.alias("from_pos"), _slice("raw", begin - F.col("from_pos"), end - begin).alias("raw"))
    return joined(found, "start_token").filter(F.octet_length("raw") == 2 * width)


def corpus_stats(docs: DataFrame, proto: bytes | None = None) -> DataFrame:
    """Totals over unstripped texts, blank ones too: documents, characters, words and tokens, a byte each without a sentencepiece model."""
    text = F.coalesce("text", F.lit(""))
    rows = token_measures(docs, proto) if proto else docs.select(F.length(text).alias("n_chars"), word_count(text).alias("n_words"), F.octet_length(text).alias("n_tokens"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("docs"), total("n_chars").alias("chars"), total("n_words").alias("words"), total("n_tokens").alias("tokens"))


def token_ratios(stats: DataFrame) -> DataFrame:
    words, tokens = F.nullif("words", F.lit(0)), F.nullif("tokens", F.lit(0))
    return stats.select((F.col("tokens") / words).alias("tokens_per_word"), (F.col("chars") / tokens).alias("chars_per_token"))


def extrapolated(stats: DataFrame, splits: list[tuple[str, int, int]]) -> DataFrame:
    """The tokens to expect of each (split, documents, words), rounded half to even."""
    rows = stats.sparkSession.createDataFrame(splits, "split string, docs long, words long")
    return rows.crossJoin(F.broadcast(token_ratios(stats))).select("split", "docs", "words", F.bround(F.col("words") * F.col("tokens_per_word")).cast("long").alias("tokens"))


def byte_budget_sample(docs: DataFrame, budget: int, *, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, before of the documents that begin before `budget` bytes of stripped text; the one that crosses it is whole.

    with_text adds the stripped text, which is what a tokenizer would be trained on. Texts are joined to the sample by id,
    after it is cut; ids name documents.
    """
    sizes = nonblank(docs).select("doc_id", F.octet_length(strip(F.col("text"))).cast("long").alias("n_bytes"))
    sample = running_total(sizes, "doc_id", "n_bytes", "before").filter(F.col("before") < budget).select("doc_id", "n_bytes", "before")
    return sample.join(nonblank(docs).select("doc_id", strip(F.col("text")).alias("text")), "doc_id") if with_text else sample


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy("doc_id").limit(n)
