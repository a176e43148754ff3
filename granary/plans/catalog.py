"""Queries by name, and for each the SQL that gives the same rows.

documents is the corpus. events stands in for a metric log: run is event_type, step the rank by event_id. embeddings
stands in for logits, label for the target. Figures with fractions are rounded on both sides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import numeric
from granary.functions.text import byte_ids, python_capitalize, strip, word_count
from granary.functions.tokenizer import decoded, draw, encoded, framed_tokens, raw_ids, token_measures, with_ids
from granary.operators import artifacts, batches, corpus, legacy, metrics, progress
from granary.sources import logs, settings
from granary.sources.files import shared_dir
from granary.sources.shards import file_digests
from granary.sources.tokens import read_blocks
from granary.streaming.ingest import ingest_prefix, ingested

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Names and sizes (documents, words) of the splits for which tokens are extrapolated.
SPLITS = [
    ("tiny", 10_000_000, 4_000_000_000), ("small", 20_000_000, 8_000_000_000), ("medium", 50_000_000, 20_000_000_000),
    ("large", 75_000_000, 30_000_000_000), ("full", 103_000_000, 41_000_000_000),
]
LENGTH, SHARD, BATCH, SEED = 1024, 50_000, 16, 42
PREFIXES = {"small": 50_000, "mid": 500_000, "large": 2_000_000}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _series(spark, sf_dir):
    """run, step, value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("run"), "event_id", "value")
    return rows.select("run", F.row_number().over(Window.partitionBy("run").orderBy("event_id")).cast("long").alias("step"), "value")


def _logits(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


_DECIMAL = [str(i) for i in range(1 << 16)]
#: Ids that are written in decimal at once.
_AT_ONCE = 1 << 16


def _digest(raw: pa.Array) -> pa.Array:
    """MD5 of each value's ids in decimal, joined by commas; few ids are Python's numbers at a time, however many a batch or a value has."""
    ids, at = raw_ids(raw)

    def one(lo: int, hi: int) -> str:
        own = hashlib.md5()
        for first in range(lo, hi, _AT_ONCE):
            own.update(b"," * (first > lo) + ",".join(map(_DECIMAL.__getitem__, ids[first : min(hi, first + _AT_ONCE)].tolist())).encode())
        return own.hexdigest()

    return pa.array(map(one, at[:-1].tolist(), at[1:].tolist()), pa.string())


def _digests(rows: DataFrame, *columns: str) -> DataFrame:
    """Each named column of 16-bit ids as the MD5 of its ids in decimal, joined by commas."""
    fields = [(c, "string" if c in columns else kind) for c, kind in rows.dtypes]
    names = [c for c, _ in fields]

    def run(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([_digest(x) if c in columns else x for c, x in zip(names, batch.columns, strict=True)], names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in fields))


_TRIM = "trim(text, chr(32) || chr(9) || chr(10) || chr(13))"
_N = f"""d AS (SELECT doc_id, {_TRIM} AS t FROM documents WHERE length({_TRIM}) > 0),
n AS (SELECT doc_id, t, (strlen(t) + 2)::BIGINT AS n_tokens, coalesce(sum(strlen(t) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos FROM d)"""
_TOKENS = f"""{_N},
x AS (SELECT doc_id, n_tokens, start_pos, hex(encode(t)) AS h, unnest(range(n_tokens)) AS i FROM n),
f AS (SELECT doc_id, start_pos + i AS pos, CASE WHEN i = 0 THEN 1 WHEN i = n_tokens - 1 THEN 2 ELSE 7 + ('0x' || substr(h, 2 * i - 1, 2))::INT END AS tok FROM x)"""
_BLOCKS = f"""{_TOKENS},
g AS (SELECT pos, tok, pos // {LENGTH} AS b FROM f UNION ALL SELECT pos, tok, pos // {LENGTH} - 1 FROM f WHERE pos % {LENGTH} = 0 AND pos > 0),
b AS (SELECT b AS block_id, list(tok ORDER BY pos) AS ids FROM g GROUP BY b HAVING count(*) = {LENGTH + 1})"""
_S = "s AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, value FROM events)"
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_BLOCK_COUNT = f"{_N}, c AS (SELECT (sum(n_tokens)::BIGINT - 1) // {LENGTH} AS n FROM n), blk AS (SELECT unnest(range(n)) AS block_id FROM c)"


# Projections, filters and totals over documents.


@query(f"SELECT count(*) AS documents_seen, count(*) FILTER (WHERE length({_TRIM}) > 0) AS documents_written FROM documents")
def nonblank_documents(spark, sf_dir):
    return corpus.document_counts(_docs(spark, sf_dir))


_STATS = r"SELECT count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))::BIGINT AS words, sum(strlen(text))::BIGINT AS tokens FROM documents"


@query(_STATS)
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(_docs(spark, sf_dir))


@query(f"WITH s AS ({_STATS}) SELECT round(tokens / words, 6) AS tokens_per_word, round(chars / tokens, 6) AS chars_per_token FROM s")
def tokens_per_word(spark, sf_dir):
    return _rounded(corpus.token_ratios(corpus.corpus_stats(_docs(spark, sf_dir))))


@query(f"WITH s AS ({_STATS}), v(split, docs, words) AS (VALUES {', '.join(map(str, SPLITS))}) SELECT v.split, v.docs::BIGINT AS docs, v.words::BIGINT AS words, round_even(v.words * (s.tokens / s.words), 0)::BIGINT AS tokens FROM v, s")
def split_extrapolation(spark, sf_dir):
    return corpus.extrapolated(corpus.corpus_stats(_docs(spark, sf_dir)), SPLITS)


@query(r"SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n_words FROM documents")
def document_measures(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), word_count(F.col("text")).alias("n_words"))


@query(f"WITH d AS (SELECT doc_id, strlen({_TRIM}) AS n_bytes FROM documents WHERE length({_TRIM}) > 0), b AS (SELECT *, coalesce(sum(n_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d) SELECT doc_id, n_bytes, before FROM b WHERE before < 1000000")
def tokenizer_sample_byte_budget(spark, sf_dir):
    return corpus.byte_budget_sample(_docs(spark, sf_dir), 1_000_000)


@query(_STATS.replace("FROM documents", "FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100)"))
def document_limit_stats(spark, sf_dir):
    return corpus.corpus_stats(corpus.first_documents(_docs(spark, sf_dir), 100))


# The token stream.


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS n_tokens, md5(string_agg(tok::VARCHAR, ',' ORDER BY pos)) AS digest FROM f GROUP BY doc_id")
def framed_byte_tokens(spark, sf_dir):
    rows = framed_tokens(_docs(spark, sf_dir))
    return _digests(rows.select("doc_id", (F.octet_length("raw") / 2).cast("long").alias("n_tokens"), F.col("raw").alias("digest")), "digest")


@query(f"WITH {_N} SELECT doc_id, n_tokens, start_pos FROM n")
def token_offsets(spark, sf_dir):
    return corpus.token_offsets(_docs(spark, sf_dir)).select("doc_id", "n_tokens", "start_pos")


def _prefix(target):
    sql = f"""WITH {_N}, u AS (SELECT *, least(n_tokens, {target} - start_pos) AS take FROM n WHERE start_pos < {target}),
    l AS (SELECT max(doc_id) AS last_doc, sum(take)::BIGINT AS token_count, count(*) AS seen, max(start_pos + n_tokens) AS e FROM u)
    SELECT {target}::BIGINT AS target, token_count, (SELECT count(*) FROM documents WHERE doc_id <= last_doc) AS documents_seen, seen AS nonempty_documents_seen,
    e = {target} AS ends_at_document_boundary, token_count = {target} AS complete FROM l"""
    return sql, lambda spark, sf_dir: corpus.prefix_report(_docs(spark, sf_dir), target)


for _name, _target in PREFIXES.items():
    _sql, _query = _prefix(_target)
    query(_sql, f"prefix_artifact_cut_{_name}")(_query)


@query(f"WITH {_N}, t AS (SELECT sum(n_tokens)::BIGINT AS total FROM n), k AS (SELECT unnest(range((total + {SHARD - 1}) // {SHARD})) AS shard, total FROM t) SELECT shard, printf('tokens-%05d.bin', shard) AS file, least({SHARD}, total - shard * {SHARD}) AS tokens, 2 * least({SHARD}, total - shard * {SHARD}) AS bytes FROM k")
def shard_manifest(spark, sf_dir):
    return artifacts.shard_manifest(corpus.token_stream(_docs(spark, sf_dir)), SHARD).select("shard", "file", "tokens", "bytes")


@query(f"WITH {_TOKENS}, k AS (SELECT pos // {SHARD} AS shard, count(*) AS tokens, sha256(unhex(string_agg(printf('%02X%02X', tok & 255, tok >> 8), '' ORDER BY pos))) AS sha256 FROM f GROUP BY 1) SELECT shard, printf('tokens-%05d.bin', shard) AS file, tokens, 2 * tokens AS bytes, sha256 FROM k")
def shard_digests(spark, sf_dir):
    return artifacts.shard_manifest(corpus.token_stream(_docs(spark, sf_dir)), SHARD)


@query(f"WITH {_BLOCKS} SELECT block_id, len(ids) AS n, ids[1] AS first_token, ids[-1] AS last_token, list_sum(ids)::BIGINT AS total FROM b")
def token_blocks(spark, sf_dir):
    found = with_ids(corpus.blocks(corpus.token_stream(_docs(spark, sf_dir)), LENGTH))
    return found.select("block_id", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_token"), F.element_at("ids", -1).alias("last_token"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {_BLOCKS} SELECT block_id, md5(array_to_string(ids[1:{LENGTH}], ',')) AS inputs, md5(array_to_string(ids[2:{LENGTH + 1}], ',')) AS targets FROM b")
def block_targets(spark, sf_dir):
    return _digests(corpus.block_targets(corpus.blocks(corpus.token_stream(_docs(spark, sf_dir)), LENGTH), LENGTH), "inputs", "targets")


def _artifact(spark, sf_dir) -> str:
    """All documents as an artifact in the shared folder."""
    root = f"{shared_dir(spark)}/granary-artifacts-{uuid.uuid4().hex}"
    artifacts.publish(corpus.token_stream(_docs(spark, sf_dir)), root, "all", SHARD)
    return f"{root}/all"


@query(f"WITH {_BLOCKS} SELECT block_id, md5(array_to_string(ids[1:{LENGTH}], ',')) AS inputs, md5(array_to_string(ids[2:{LENGTH + 1}], ',')) AS targets FROM b")
def artifact_block_reads(spark, sf_dir):
    """Blocks as the data source reads them from the shards that the writer put in place."""
    joined = lambda c: F.md5(F.concat_ws(",", F.col(c).cast("array<string>")).cast("binary")).alias(c)
    return read_blocks(spark, _artifact(spark, sf_dir), LENGTH, blocks_per_task=256).select("block_id", joined("inputs"), joined("targets"))


@query(f"WITH {_TOKENS}, k AS (SELECT pos // {SHARD} AS shard, count(*) AS tokens, sha256(unhex(string_agg(printf('%02X%02X', tok & 255, tok >> 8), '' ORDER BY pos))) AS sha256 FROM f GROUP BY 1) SELECT printf('tokens-%05d.bin', shard) AS file, 2 * tokens AS bytes, sha256 FROM k")
def artifact_file_digests(spark, sf_dir):
    return file_digests(spark, _artifact(spark, sf_dir), "tokens-*.bin")


@query(f"WITH {_N}, t AS (SELECT sum(n_tokens)::BIGINT AS n FROM n), k AS (SELECT unnest(range((n + {SHARD - 1}) // {SHARD})) AS shard, n FROM t) SELECT printf('all/tokens-%05d.bin', shard) AS file, 2 * least({SHARD}, n - shard * {SHARD}) AS bytes FROM k")
def artifact_listing(spark, sf_dir):
    """The shards in a listing of the folder above the artifact."""
    listed = logs.list_checkpoints(spark, _artifact(spark, sf_dir).rpartition("/")[0], recursive=True)
    return listed.select(F.regexp_extract("path", r"(all/tokens-\d+\.bin)$", 1).alias("file"), "bytes").filter("file <> ''")


@query(f"WITH {_N} SELECT doc_id, start_pos, least(n_tokens, {PREFIXES['mid']} - start_pos) AS n_tokens FROM n WHERE start_pos < {PREFIXES['mid']}")
def stream_to_target(spark, sf_dir):
    """Documents as a stream of files that stops at a token target."""
    out = f"{shared_dir(spark)}/granary-ingest-{uuid.uuid4().hex}"
    ingest_prefix(spark, f"{sf_dir}/documents.parquet*", f"{out}/rows", f"{out}/checkpoint", PREFIXES["mid"], files_per_batch=64)
    return ingested(spark, f"{out}/rows").select("doc_id", "start_pos", "n_tokens")


_STARTS = [0, 1_011, 25_000, 25_500, 100_050]


@query(f"WITH {_TOKENS}, st(start_token) AS (VALUES {', '.join(f'({s})' for s in _STARTS)}) SELECT start_token::BIGINT AS start_token, count(*) AS n, md5(string_agg(tok::VARCHAR, ',' ORDER BY pos)) AS digest FROM f JOIN st ON pos BETWEEN start_token AND start_token + {LENGTH} GROUP BY start_token HAVING count(*) = {LENGTH + 1}")
def fixed_eval_blocks(spark, sf_dir):
    starts = spark.createDataFrame([(s,) for s in _STARTS], "start_token long")
    found = corpus.evaluation_blocks(_docs(spark, sf_dir), starts, LENGTH)
    return _digests(found.select("start_token", (F.octet_length("raw") / 2).cast("long").alias("n"), F.col("raw").alias("digest")), "digest")


@query(f"WITH {_N} SELECT doc_id, start_pos, start_pos // {SHARD} AS shard, start_pos % {SHARD} AS offset_in_shard FROM n")
def position_to_shard(spark, sf_dir):
    at = F.col("start_pos")
    return corpus.token_offsets(_docs(spark, sf_dir)).select("doc_id", "start_pos", F.floor(at / SHARD).alias("shard"), (at % SHARD).alias("offset_in_shard"))


@query(f"WITH {_N}, k AS (SELECT start_pos // {SHARD} AS shard, n_tokens FROM n), t AS (SELECT sum(n_tokens)::BIGINT AS tokens, count(*) AS documents FROM k) SELECT tokens, 2 * tokens AS bytes, (tokens + {SHARD - 1}) // {SHARD} + 1 AS files, documents, round(2 * tokens / 1073741824, 6) AS gib FROM t")
def artifact_totals(spark, sf_dir):
    t = corpus.token_offsets(_docs(spark, sf_dir)).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    return t.select("tokens", (F.col("tokens") * 2).alias("bytes"), (F.ceil(F.col("tokens") / SHARD) + 1).alias("files"), "documents", F.round(F.col("tokens") * 2 / 1073741824, 6).alias("gib"))


@query("""WITH d AS (SELECT 'f' || (doc_id % 50) AS file, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1),
a AS (SELECT CASE WHEN doc_id % 50 IN (7, 30) THEN 'other' || (doc_id % 50) ELSE 'f' || (doc_id % 50) END AS file, (sum(n_chars) + max(CASE WHEN doc_id % 50 IN (11, 12) THEN 1 ELSE 0 END))::BIGINT AS bytes FROM documents GROUP BY 1)
SELECT coalesce(d.file, a.file) AS file, CASE WHEN a.file IS NULL THEN 'missing' WHEN d.file IS NULL THEN 'extra' ELSE 'size' END AS fault FROM d FULL JOIN a ON d.file = a.file WHERE a.file IS NULL OR d.file IS NULL OR a.bytes <> d.bytes""")
def artifact_inventory_check(spark, sf_dir):
    """All documents on both sides; two files are found under other names, and two are found a byte too long."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 50).alias("k"), "n_chars")
    named = lambda prefix: F.concat(F.lit(prefix), F.col("k").cast("string"))
    declared = docs.groupBy(named("f").alias("file")).agg(F.sum("n_chars").alias("bytes"))
    found = docs.groupBy(F.when(F.col("k").isin(7, 30), named("other")).otherwise(named("f")).alias("file")).agg((F.sum("n_chars") + F.max(F.col("k").isin(11, 12).cast("long"))).alias("bytes"))
    return artifacts.inventory_faults(declared, found)


# Epochs and batches.


def _blocks(spark, sf_dir):
    total = corpus.token_offsets(_docs(spark, sf_dir)).agg(F.sum("n_tokens")).first()[0] or 0
    return spark.range(max(0, (total - 1) // LENGTH)).withColumnRenamed("id", "block_id")


_SHUFFLED = f"{_BLOCK_COUNT}, r AS (SELECT block_id, row_number() OVER (ORDER BY md5('{SEED + 1}:' || block_id), block_id) - 1 AS rank FROM blk)"


@query(f"WITH {_SHUFFLED} SELECT 1 AS epoch, rank // {BATCH} AS batch_id, (rank % {BATCH})::INT AS slot, block_id FROM r, c WHERE rank // {BATCH} < n // {BATCH}")
def epoch_shuffle_batches(spark, sf_dir):
    return batches.train_batches(_blocks(spark, sf_dir), BATCH, SEED, 1)


@query(f"WITH {_SHUFFLED} SELECT 1 AS epoch, rank // {BATCH} AS batch_id, (rank % {BATCH})::INT AS slot, block_id FROM r, c WHERE rank // {BATCH} < n // {BATCH} AND rank // {BATCH} >= 5")
def resume_cursor(spark, sf_dir):
    return batches.train_batches(_blocks(spark, sf_dir), BATCH, SEED, 1, start_batch=5)


@query(f"WITH {_BLOCK_COUNT} SELECT block_id // {BATCH} AS batch_id, (block_id % {BATCH})::INT AS slot, block_id FROM blk WHERE block_id // {BATCH} < 7")
def validation_batches(spark, sf_dir):
    return batches.validation_batches(_blocks(spark, sf_dir), BATCH, 7)


@query(f"WITH {_BLOCK_COUNT} SELECT n // {BATCH} // 2 AS steps_per_epoch, least(n // {BATCH} // 2 * 3, 100) AS total_steps FROM c")
def optimizer_horizon(spark, sf_dir):
    each, total = batches.horizon(_blocks(spark, sf_dir).count(), BATCH, 2, 3, 100)
    return spark.createDataFrame([(each, total)], "steps_per_epoch long, total_steps long")


@query(f"WITH {_S}, b AS (SELECT run, step // 7 AS batch, sum(value) AS loss_sum, count(*) AS tokens FROM s GROUP BY 1, 2) SELECT round(sum(loss_sum) / sum(tokens), 6) AS loss, sum(tokens)::BIGINT AS tokens FROM b")
def weighted_validation_loss(spark, sf_dir):
    rows = _series(spark, sf_dir).groupBy("run", F.floor(F.col("step") / 7).alias("batch")).agg(F.sum("value").alias("loss_sum"), F.count("*").alias("tokens"))
    return _rounded(batches.weighted_loss(rows))


# Metric logs.


@query("SELECT event_type AS run, event_type || '/value' AS tag, count(*) AS n FROM events GROUP BY 1, 2")
def metric_inventory(spark, sf_dir):
    return metrics.inventory(_series(spark, sf_dir).withColumn("tag", F.concat("run", F.lit("/value"))))


_PADDED = f"""{_S}, q AS (SELECT run, min(step) AS lo, max(step) AS hi, arg_min(value, step) AS a, arg_max(value, step) AS z FROM s GROUP BY run),
p AS (SELECT run, step, value, FALSE AS pad FROM s UNION ALL SELECT run, lo - i, a, TRUE FROM q, range(1, 101) r(i) UNION ALL SELECT run, hi + i, z, TRUE FROM q, range(1, 101) r(i)),
m AS (SELECT run, step, value, pad, quantile_cont(value, 0.5) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS median FROM p),
k AS (SELECT run, step, value, median, value - median AS residual FROM m WHERE NOT pad)"""


@query(f"WITH {_PADDED} SELECT run, step, round(median, 6) AS median, round(residual, 6) AS residual FROM k")
def rolling_median_residual(spark, sf_dir):
    return _rounded(metrics.rolling_median(_series(spark, sf_dir)).select("run", "step", "median", "residual"))


@query(f"""WITH {_PADDED.replace("s AS (SELECT", "s0 AS (SELECT", 1)
    .replace("FROM events)", "FROM events), s AS (SELECT run, step, value * 0.7 + step % 13 AS value FROM s0)", 1)},
a AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(residual) OVER w END AS ahead FROM k WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
g AS (SELECT run, CASE WHEN step % 97 = 0 THEN -step ELSE step END AS step, value AS grad FROM s0),
c AS (SELECT coalesce(g.run, a.run) AS run, coalesce(g.step, a.step) AS step, grad, residual, ahead FROM g FULL JOIN a ON g.run = a.run AND g.step = a.step),
i AS (SELECT run, value + step % 7 - lag(value + step % 7) OVER (PARTITION BY run ORDER BY step) AS change FROM s0), j AS (SELECT run, max(change) AS largest_increase, count(*) FILTER (WHERE change > 0) AS increases FROM i GROUP BY run)
SELECT c.run, count(grad) AS steps, round(quantile_cont(grad, 0.5) FILTER (WHERE step > 50), 6) AS median_grad, round(quantile_cont(grad, 0.99) FILTER (WHERE step > 50), 6) AS p99_grad, round(max(grad) FILTER (WHERE step > 50), 6) AS max_grad,
count(*) FILTER (WHERE step > 50 AND grad > 90) AS clipped_steps, round(100 * count(*) FILTER (WHERE step > 50 AND grad > 90) / count(*) FILTER (WHERE step > 50), 6) AS clipped_percent,
round(quantile_cont(residual, 0.95) FILTER (WHERE step > 50), 6) AS loss_residual_p95, round(quantile_cont(residual, 0.99) FILTER (WHERE step > 50), 6) AS loss_residual_p99,
round(quantile_cont(residual, 0.5) FILTER (WHERE step > 50 AND grad > 90), 6) AS loss_residual_at_clipped_median, round(avg(ahead) FILTER (WHERE step > 50 AND grad > 90), 6) AS next_loss_residual_mean,
count(*) FILTER (WHERE grad IS NULL OR residual IS NULL) AS unaligned, round(any_value(largest_increase), 6) AS largest_increase, any_value(increases) AS increases FROM c JOIN j ON c.run = j.run GROUP BY c.run""")
def spike_summary(spark, sf_dir):
    """Three series: gradient norms, of which each 97th has a wrong step; losses; validation losses."""
    grad = _series(spark, sf_dir)
    loss = grad.withColumn("value", F.col("value") * 0.7 + F.col("step") % 13)
    validation = grad.withColumn("value", F.col("value") + F.col("step") % 7)
    grad = grad.withColumn("step", F.when(F.col("step") % 97 == 0, -F.col("step")).otherwise(F.col("step")))
    return _rounded(metrics.spike_summary(grad, loss, validation, after_step=50, limit=90.0))


@query(f"WITH {_S}, i AS (SELECT run, value - lag(value) OVER (PARTITION BY run ORDER BY step) AS change FROM s) SELECT run, round(max(change), 6) AS largest_increase, count(*) FILTER (WHERE change > 0) AS increases FROM i GROUP BY run")
def validation_increases(spark, sf_dir):
    return _rounded(metrics.increases(_series(spark, sf_dir)))


@query(f"WITH {_S} SELECT run, step, round(sum((value > 50)::INT) OVER (PARTITION BY run ORDER BY step) / step, 6) AS clip_fraction FROM s")
def clip_fraction(spark, sf_dir):
    return _rounded(metrics.clip_fraction(_series(spark, sf_dir), 50.0).select("run", "step", "clip_fraction"))


@query(f"WITH {_S} SELECT run, step, (sum(16) OVER (PARTITION BY run ORDER BY step))::BIGINT AS tokens_seen FROM s")
def tokens_seen(spark, sf_dir):
    rows = _series(spark, sf_dir).select("run", "step", F.lit(16).cast("long").alias("value"))
    return metrics.running(rows, "sum", "tokens_seen").select("run", "step", "tokens_seen")


@query(f"WITH {_S} SELECT run, step, min(value) OVER (PARTITION BY run ORDER BY step) AS best FROM s")
def best_validation(spark, sf_dir):
    return metrics.running(_series(spark, sf_dir), "min", "best").select("run", "step", "best")


@query(f"WITH {_S}, t AS (SELECT run, value, ntile(10) OVER (PARTITION BY run ORDER BY step) AS d FROM s) SELECT run, d::INT AS decile, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99 FROM t GROUP BY 1, 2")
def decile_regions(spark, sf_dir):
    return _rounded(metrics.deciles(_series(spark, sf_dir)))


@query(f"WITH {_S}, t AS (SELECT run, abs(value - avg(value) OVER w) AS off, stddev_pop(value) OVER w AS dev FROM s WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT run, round(100 * count(*) FILTER (WHERE dev > 1e-9 AND off >= 1.5 * dev) / count(*), 4) AS spike_percent FROM t GROUP BY run")
def spike_score(spark, sf_dir):
    return _rounded(metrics.spike_score(_series(spark, sf_dir), 1.5, 100), 4)


@query(f"WITH {_S} SELECT run, step, value FROM s WHERE step <= 100")
def metric_purge(spark, sf_dir):
    return metrics.purge_after(_series(spark, sf_dir), 100)


_THROUGHPUT = (3, 6, 4)  # interval, validation, checkpoint


def _step_log(series):
    return series.select("run", "step", (F.col("step") * 16).alias("tokens_seen"), (1 + F.col("step") % 3).cast("double").alias("seconds"))


@query(f"""WITH RECURSIVE {_S}, z AS (SELECT run, max(step) AS last FROM s GROUP BY run), t AS (SELECT run, step, sum((1 + step % 3)::DOUBLE) OVER (PARTITION BY run ORDER BY step) AS spent FROM s),
g AS (SELECT run, last, 0::BIGINT AS since, least(3, CASE WHEN 4 < last THEN 4 ELSE last END, last) AS step FROM z
UNION ALL SELECT run, last, step, least(step + 3, (step // 6 + 1) * 6, CASE WHEN (step // 4 + 1) * 4 < last THEN (step // 4 + 1) * 4 ELSE last END, last) FROM g WHERE step < last)
SELECT g.run, g.step, (g.step - g.since) * 16 AS tokens, b.spent - coalesce(a.spent, 0) AS seconds, round((g.step - g.since) * 16 / (b.spent - coalesce(a.spent, 0)), 6) AS tokens_per_second
FROM g JOIN t b ON b.run = g.run AND b.step = g.step LEFT JOIN t a ON a.run = g.run AND a.step = g.since""")
def throughput_windows(spark, sf_dir):
    return _rounded(metrics.throughput_windows(_step_log(_series(spark, sf_dir)), *_THROUGHPUT))


_PARAMETERS = "CASE event_id % 9 WHEN 0 THEN 'embeddings.weight' WHEN 1 THEN 'blocks.0.attn.c_attn.weight' WHEN 2 THEN 'blocks.0.attn.q_proj.weight' WHEN 3 THEN 'blocks.1.attn.k_proj.weight' WHEN 4 THEN 'blocks.0.attn.c_proj.weight' WHEN 5 THEN 'blocks.0.ffn.w1.weight' WHEN 6 THEN 'blocks.0.ffn.w2.weight' WHEN 7 THEN 'blocks.0.attn_norm.weight' ELSE 'head.bias' END"


@query(f"""WITH p AS (SELECT {_PARAMETERS} AS name, value FROM events), g AS (SELECT CASE WHEN name = 'embeddings.weight' THEN 'embeddings' WHEN contains(name, '.attn.c_attn.') THEN 'attention_qkv' WHEN contains(name, '.attn.q_proj.') THEN 'attention_query' WHEN contains(name, '.attn.k_proj.') THEN 'attention_key'
WHEN contains(name, '.attn.c_proj.') THEN 'attention_output' WHEN contains(name, '.ffn.w1.') THEN 'ffn_input_gate' WHEN contains(name, '.ffn.w2.') THEN 'ffn_output' WHEN contains(name, '_norm.') THEN 'norms' ELSE 'other' END AS g, value FROM p),
u AS (SELECT g AS "group", value FROM g UNION ALL SELECT 'attention_qkv', value FROM g WHERE g IN ('attention_query', 'attention_key', 'attention_value')) SELECT "group", round(sqrt(sum(value * value)), 4) AS norm, count(*) AS n FROM u GROUP BY 1""")
def gradient_group_norms(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_PARAMETERS).alias("name"), "value")
    return _rounded(metrics.group_norms(rows), 4)


@query(f"WITH p AS (SELECT DISTINCT {_PARAMETERS} AS name FROM events), d AS (SELECT name, CASE WHEN contains(name, 'norm') OR contains(name, 'bias') THEN 1 ELSE 2 END AS dims FROM p) SELECT name, dims, CASE WHEN contains(name, '_norm.') OR name = 'norm.weight' THEN 'norm' WHEN dims = 2 AND name <> 'embeddings.weight' THEN 'muon' WHEN dims >= 2 AND name <> 'embeddings.weight' THEN 'decay' ELSE 'no_decay' END AS optimizer_group FROM d")
def parameter_partition(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_PARAMETERS).alias("name")).distinct()
    rows = names.withColumn("dims", F.when(F.col("name").contains("norm") | F.col("name").contains("bias"), 1).otherwise(2))
    return rows.withColumn("optimizer_group", metrics.optimizer_group(F.col("name"), F.col("dims"), muon=True))


@query("""WITH n AS (SELECT DISTINCT 'run' || (user_id % 40) AS model_path, event_type FROM events), e AS (SELECT DISTINCT 'run' || (user_id % 40 + 7) AS model_path, event_type FROM events)
SELECT n.model_path, 'config = {name = "' || n.event_type || '", training = {epochs = 3}}' AS config FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.model_path = n.model_path AND e.event_type = n.event_type)""")
def registry_append_dedup(spark, sf_dir):
    """The registry has its configurations on several lines, the new rows on one."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct()
    path = lambda n: F.concat(F.lit("run"), (F.col("user_id") % 40 + n).cast("string")).alias("model_path")
    there = rows.select(path(7), F.format_string('name = "%s"\n\n[training]\nepochs = 3\n', "event_type").alias("config"))
    return metrics.new_registry_rows(there, rows.select(path(0), F.format_string('config = {name = "%s", training = {epochs = 3}}', "event_type").alias("config")))


@query("""WITH n AS (SELECT DISTINCT 'run' || (user_id % 40) AS model_path, event_type FROM events), e AS (SELECT DISTINCT 'run' || (user_id % 40 + 7) AS model_path, event_type FROM events),
a AS (SELECT *, '\t' || printf('name = "%s"\n\n[training]\nepochs = 3\n', event_type) AS config FROM e UNION ALL
SELECT *, 'config = {name = "' || event_type || '", training = {epochs = 3}}' FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.model_path = n.model_path AND e.event_type = n.event_type))
SELECT 'run of "' || event_type || '", whole' AS experiment_name, model_path, config FROM a""")
def registry_files(spark, sf_dir):
    """A registry's file after three appends, the last of which adds nothing."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct()
    path = f"{shared_dir(spark)}/granary-registry-{uuid.uuid4().hex}"
    first, second = '\tname = "%s"\n\n[training]\nepochs = 3\n', 'config = {name = "%s", training = {epochs = 3}}'
    for form, shift in ((first, 7), (second, 0), (first, 0)):
        text = lambda form: F.format_string(form, "event_type")
        told = {"config": text(form), "experiment_name": text('run of "%s", whole'), "model_path": F.concat(F.lit("run"), (F.col("user_id") % 40 + shift).cast("string"))}
        blank = {name: F.lit(None).cast("string") for name in spark.createDataFrame([], metrics.REGISTRY).columns if name not in told}
        logs.append_registry(spark, path, rows.select(*[c.alias(name) for name, c in {**told, **blank}.items()]))
    return logs.read_registry(spark, path).select("experiment_name", "model_path", "config")


@query(f"WITH {_S} SELECT run || '=a/b %41' AS run, 'train/\"' || run || '\", ' AS tag, step, step / 8.0 AS wall_time, value FROM s")
def metric_files(spark, sf_dir):
    """Metric logs written a folder a run, and read back; runs and tags hold signs that paths and CSV set apart."""
    path = f"{shared_dir(spark)}/granary-metrics-{uuid.uuid4().hex}"
    tag = F.concat(F.lit('train/"'), "run", F.lit('", '))
    logs.write_metrics(_series(spark, sf_dir).select("value", "step", (F.col("step") / 8.0).alias("wall_time"), tag.alias("tag"), F.concat("run", F.lit("=a/b %41")).alias("run")), path)
    return logs.read_metrics(spark, path)


@query("WITH f AS (SELECT 'r' || (user_id % 5) || '/' || CASE WHEN event_id % 3 = 0 THEN 'notes.txt' ELSE printf('step_%08d.pt', event_id) END AS path, (event_id * 7919 % 100003)::BIGINT AS mtime_ns FROM events), m AS (SELECT * FROM f WHERE contains(path, 'step_')) SELECT path, mtime_ns, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY mtime_ns DESC, path DESC) <= 25 AS keep FROM m")
def checkpoint_retention(spark, sf_dir):
    name = F.when(F.col("event_id") % 3 == 0, F.lit("notes.txt")).otherwise(F.format_string("step_%08d.pt", F.col("event_id")))
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string"), F.lit("/"), name).alias("path"), (F.col("event_id") * 7919 % 100003).cast("long").alias("mtime_ns"))
    return metrics.retained(files, 25)


_OLD_KEYS = ["VOCAB_SIZE", "N_BLOCKS", "EMBED_DIM", "ATTN_HEADS", "FFN_DIM", "SEQ_LEN", "ROPE_BASE", "QK_NORM", "attn_bias", "ATTN_BIAS", "OTHER"]
_OLD_VALUES = ["12", " 8 ", "Yes", "off", "1", "1e4", "two", "0"]
_OLD_WEIGHTS = ["layers.0.attn.q_proj.weight", "layers.0.ca.weight", "layers.1.ffn.cd.weight", "layers.0.attn.c_proj.bias", "norm.weight", "layers.2.attn.q_norm.weight", "head.ca.weight.old"]
_KINDS = legacy.kinds()
_listed = lambda names: ", ".join(f"'{n}'" for n in names)


@query(f"""WITH e AS (SELECT event_id, user_id AS run FROM events),
s AS (SELECT run, [{_listed(_OLD_KEYS)}][event_id % {len(_OLD_KEYS)} + 1] AS key, arg_max([{_listed(_OLD_VALUES)}][(event_id // {len(_OLD_KEYS)} + run) % {len(_OLD_VALUES)} + 1], event_id) AS value FROM e GROUP BY 1, 2),
w AS (SELECT run, [{_listed(_OLD_WEIGHTS)}][(event_id + run) % {len(_OLD_WEIGHTS)} + 1] AS name, CASE WHEN run % 3 = 0 AND event_id % 2 = 0 THEN 4 ELSE 3 END AS last_size FROM e WHERE event_id % 4 < 2),
k(name, kind) AS (VALUES {', '.join(f"('{n}', '{k}')" for n, k in _KINDS.items())}),
r AS (SELECT run, k.name, CASE kind WHEN 'bool' THEN CASE WHEN lower(trim(value)) IN ('true', 'yes', 'on', '1') THEN 'true' WHEN lower(trim(value)) IN ('false', 'no', 'off', '0') THEN 'false' END
      WHEN 'int' THEN CASE WHEN regexp_full_match(trim(value), '[0-9]+') THEN trim(value) END WHEN 'float' THEN try_cast(trim(value) AS DOUBLE)::VARCHAR ELSE trim(value) END AS value FROM s JOIN k ON s.key = upper(k.name)),
f AS (SELECT run, bool_or(contains(name, '.attn.q_proj.weight')) AS a, bool_or(contains(name, '.attn.q_norm.weight')) AS b, bool_or(contains(name, '.ca.weight')) AS c,
      bool_or(ends_with(name, '.attn.c_proj.bias')) AS d, list(DISTINCT last_size) FILTER (ends_with(name, '.ca.weight') OR ends_with(name, '.ffn.cd.weight')) AS sizes FROM w GROUP BY run),
u AS (SELECT DISTINCT run FROM s),
i AS (SELECT run, unnest(['split_qkv_projections', 'qk_norm', 'canon_layers', 'attn_bias', 'canon_kernel_size']) AS name,
      unnest([coalesce(a, FALSE)::VARCHAR, coalesce(b, FALSE)::VARCHAR, coalesce(c, FALSE)::VARCHAR, coalesce(d, FALSE)::VARCHAR, CASE WHEN len(sizes) = 1 THEN sizes[1]::VARCHAR END]) AS value,
      unnest([NULL, NULL, NULL, NULL, CASE WHEN len(sizes) > 1 THEN 'kernels' END]) AS fault FROM u LEFT JOIN f USING (run)),
m AS (SELECT run, unnest([{_listed(legacy.REQUIRED)}]) AS name FROM u)
SELECT run, name, value, FALSE AS inferred, CASE WHEN value IS NULL THEN 'value' END AS fault FROM r
UNION ALL SELECT run, name, value, TRUE, fault FROM i WHERE (value IS NOT NULL OR fault IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM r WHERE r.run = i.run AND r.name = i.name)
UNION ALL SELECT run, name, NULL, FALSE, 'missing' FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run = m.run AND r.name = m.name)""")
def legacy_config_parse(spark, sf_dir):
    """Each user is an old run; its events are what it recorded, good and bad, and the names of its weights."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("run"))
    pick = lambda names, at: F.get(F.lit(names), (at % len(names)).cast("int"))
    at = F.floor(F.col("event_id") / len(_OLD_KEYS)) + F.col("run")
    recorded = rows.groupBy("run", pick(_OLD_KEYS, F.col("event_id")).alias("key")).agg(F.max_by(pick(_OLD_VALUES, at), "event_id").alias("value"))
    size = F.when((F.col("run") % 3 == 0) & (F.col("event_id") % 2 == 0), 4).otherwise(3)
    weights = rows.filter("event_id % 4 < 2").select("run", pick(_OLD_WEIGHTS, F.col("event_id") + F.col("run")).alias("name"), size.alias("last_size"))
    return legacy.legacy_settings(recorded, weights)


@query("SELECT source, upper(substr(replace(source || '_Run_X', '_', ' '), 1, 1)) || lower(substr(replace(source || '_Run_X', '_', ' '), 2)) AS label, CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 300 END AS millions, count(*) AS n FROM documents GROUP BY ALL")
def run_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    variant = F.when(F.col("doc_id") % 2 == 0, "web_1b").otherwise("web_300m")
    label = python_capitalize(F.replace(F.concat("source", F.lit("_Run_X")), F.lit("_"), F.lit(" ")))
    return docs.select("source", label.alias("label"), metrics.variant_millions(variant).alias("millions")).groupBy("source", "label", "millions").agg(F.count("*").alias("n"))


@query(f"WITH {_S}, b AS (SELECT run, avg(value) / 100 AS loss FROM s GROUP BY run) SELECT run, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM b")
def perplexity(spark, sf_dir):
    rows = _series(spark, sf_dir).groupBy("run").agg((F.avg("value") / 100).alias("loss"))
    return _rounded(rows.withColumn("perplexity", F.exp("loss")))


@query(f"WITH {_S}, m AS (SELECT DISTINCT run AS mix FROM s), z AS (SELECT unnest([100, 300, 1000]) AS size), c AS (SELECT CASE WHEN run = 'click' THEN 'unlisted' ELSE run END AS run, count(*) AS n FROM s GROUP BY 1) SELECT mix, size, coalesce(n, 0) AS n, coalesce(CASE WHEN n IS NOT NULL THEN 'log' END, 'No log supplied') AS state FROM m CROSS JOIN z LEFT JOIN c ON c.run = m.mix")
def log_grid(spark, sf_dir):
    series = _series(spark, sf_dir)
    sizes = spark.createDataFrame([(100,), (300,), (1000,)], "size int")
    named = F.when(F.col("run") == "click", "unlisted").otherwise(F.col("run"))  # the log of one mix lies under another name
    counts = series.groupBy(named.alias("mix")).agg(F.count("*").alias("n"))
    grid = series.select(F.col("run").alias("mix")).distinct().crossJoin(F.broadcast(sizes))
    return grid.join(counts, "mix", "left").select("mix", "size", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNotNull(), "log").otherwise("No log supplied").alias("state"))


# What a step logs, states and records. events stands in: parameter names from event ids, runs from event types.


@query(f"WITH {_S} SELECT run, (step - 1) // 4 + 1 AS step, round(avg(value), 6) AS loss, count(*) AS batches FROM s GROUP BY 1, 2 HAVING count(*) = 4")
def step_losses(spark, sf_dir):
    rows = _series(spark, sf_dir).select("run", (F.col("step") - 1).alias("micro_batch"), F.col("value").alias("loss"))
    return _rounded(metrics.step_losses(rows, 4))


@query(f"WITH p AS (SELECT {_PARAMETERS} AS name, value FROM events) SELECT name, round(sqrt(sum(value * value)), 4) AS norm, round(sqrt(sum(value * value) / count(*)), 6) AS rms, count(*) AS numel FROM p GROUP BY name UNION ALL SELECT '', round(sqrt(sum(value * value)), 4), round(sqrt(sum(value * value) / count(*)), 6), count(*) FROM p")
def parameter_norms(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_PARAMETERS).alias("name"), "value")
    found = metrics.parameter_norms(rows, "name").unionByName(metrics.parameter_norms(rows).withColumn("name", F.lit("")))
    return found.select("name", F.round("norm", 4).alias("norm"), F.round("rms", 6).alias("rms"), "numel")


@query(f"WITH p AS (SELECT {_PARAMETERS} AS name, count(*) AS numel FROM events GROUP BY 1) SELECT sum(numel)::BIGINT AS total, (sum(numel) FILTER (WHERE name <> 'head.bias'))::BIGINT AS trainable FROM p")
def parameter_totals(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr(_PARAMETERS).alias("name")).agg(F.count("*").alias("numel"))
    return metrics.parameter_totals(rows.withColumn("trainable", F.col("name") != "head.bias"))


@query("WITH p AS (SELECT DISTINCT user_id AS u FROM events), g AS (SELECT 'p' || u AS name, 'decay' AS grp FROM p WHERE u % 3 < 2 UNION ALL SELECT 'p' || u, 'norm' FROM p WHERE u % 3 > 0 UNION ALL SELECT 'q' || u, 'norm' FROM p WHERE u % 3 = 0), c AS (SELECT name, count(*) AS n FROM g GROUP BY name), r AS (SELECT 'p' || u AS own, n, c.name FROM p FULL JOIN c ON c.name = 'p' || u) SELECT count(own) AS parameters, count(n) AS assigned, count(*) FILTER (WHERE n IS NULL) AS ungrouped, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE own IS NULL) AS unexpected, count(*) FILTER (WHERE n IS NULL OR n > 1 OR own IS NULL) = 0 AS ok FROM r")
def parameter_partition_check(spark, sf_dir):
    """Each user is a parameter; by its number it is in one group, in two, or in one beside a stranger."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    named = lambda prefix, group: F.struct(F.concat(F.lit(prefix), F.col("u").cast("string")).alias("name"), F.lit(group).alias("group"))
    both = F.when(F.col("u") % 3 == 0, F.array(named("p", "decay"), named("q", "norm"))).when(F.col("u") % 3 == 1, F.array(named("p", "decay"), named("p", "norm"))).otherwise(F.array(named("p", "norm")))
    return metrics.partition_check(users.select(named("p", "")["name"].alias("name")), users.select(F.explode(both).alias("g")).select("g.*"))


@query("WITH p AS (SELECT user_id AS id, min(event_type || '.' || user_id) AS name FROM events GROUP BY 1) SELECT 'opt' || id % 2 AS optimizer, id % 5 AS \"group\", array_to_string(list(name ORDER BY id), ',') AS names FROM p GROUP BY ALL")
def optimizer_parameter_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("parameter_id"), F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("name")).distinct()
    groups = rows.select("parameter_id").distinct().select(F.concat(F.lit("opt"), (F.col("parameter_id") % 2).cast("string")).alias("optimizer"), (F.col("parameter_id") % 5).alias("group"), F.col("parameter_id").alias("position"), "parameter_id")
    return metrics.optimizer_names(rows, groups).select("optimizer", "group", F.array_join("names", ",").alias("names"))


@query("WITH a AS (SELECT DISTINCT event_type AS part, user_id % 50 AS k FROM events), b AS (SELECT DISTINCT event_type AS part, user_id % 50 + 3 AS k FROM events) SELECT part, 'w' || k AS name, 'missing' AS fault FROM a ANTI JOIN b USING (part, k) UNION ALL SELECT part, 'w' || k, 'unexpected' FROM b ANTI JOIN a USING (part, k)")
def state_key_faults(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("part"), (F.col("user_id") % 50).alias("k")).distinct()
    keys = lambda n: rows.select("part", F.concat(F.lit("w"), (F.col("k") + n).cast("string")).alias("name"))
    return metrics.key_faults(keys(0), keys(3))


_PATHS = ("model.embed_dim", "optimizer.lr", "optimizer.schedule.total_steps", "training.epochs", "evaluation.steps", "logging.level", "model.unheard_of")


@query(f"WITH p(i, path) AS (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(_PATHS))}), r AS (SELECT DISTINCT user_id AS run FROM events), l AS (SELECT run, path || '=' || (run * (i + 1) % 3) AS line FROM r, p WHERE path IN ('model.embed_dim', 'optimizer.lr', 'training.epochs', 'evaluation.steps')) SELECT run, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS signature FROM l GROUP BY run")
def training_signatures(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run")).distinct()
    rows = runs.select("run", F.posexplode(F.lit(list(_PATHS))).alias("i", "path"))
    return metrics.signatures(rows.select("run", "path", (F.col("run") * (F.col("i") + 1) % 3).cast("string").alias("value")), list(settings.SETTINGS))


@query("WITH s AS (SELECT source, lang, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY 1, 2), n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY lang) AS shard, tokens, sha256(lang) AS sha FROM s), j AS (SELECT source, string_agg('{\"sha256\": \"' || sha || '\", \"tokens\": ' || tokens || '}', ', ' ORDER BY shard) AS parts, sum(tokens)::BIGINT AS total FROM n GROUP BY 1) SELECT source AS artifact, sha256('{\"fixed_evaluation_sample\": null, \"shards\": [' || parts || '], \"storage\": {\"dtype\": \"uint16\", \"endianness\": \"little\", \"layout\": \"flat_token_stream\"}, \"token_count\": ' || total || ', \"tokenizer_sha256\": \"' || sha256(source) || '\", \"vocab_size\": 16384}') AS identity FROM j")
def dataset_identities(spark, sf_dir):
    """Each source is an artifact, its languages are its shards."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("artifact"), "lang").agg(F.sum("n_chars").alias("tokens"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    shards = rows.select("artifact", F.col("lang").alias("shard"), "tokens", digest("lang").alias("sha256"))
    return artifacts.identities(shards, rows.select("artifact").distinct().select("artifact", digest("artifact").alias("tokenizer_sha256"), F.lit(16384).alias("vocab_size")))


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source AS artifact, n % 3 = 0 AND n % 4 <> 1 AS ok, CASE WHEN n % 3 <> 0 THEN 'tokenizers differ' WHEN n % 4 = 1 THEN 'vocabulary size differs from the model''s' ELSE '' END AS detail FROM s")
def tokenizer_compatibility(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("artifact")).agg(F.count("*").alias("n"))
    train = rows.select("artifact", F.lit("0").alias("tokenizer_sha256"), F.lit(16384).alias("vocab_size"))
    held = rows.select("artifact", (F.col("n") % 3).cast("string").alias("tokenizer_sha256"), F.when(F.col("n") % 4 == 1, 8192).otherwise(16384).alias("vocab_size"))
    return artifacts.compatibility(train, held, 16384)


_SHARDS_OF = f"{_N}, w AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM n JOIN documents USING (doc_id) GROUP BY source), e AS (SELECT source AS shard, tokens, (sum(tokens) OVER (ORDER BY source))::BIGINT AS end_pos FROM w)"


@query(f"WITH {_SHARDS_OF} SELECT shard, tokens, end_pos - tokens AS first_pos, end_pos FROM e")
def shard_ends(spark, sf_dir):
    return corpus.shard_ends(_source_shards(spark, sf_dir))


def _source_shards(spark, sf_dir):
    """Shards of uneven sizes: a source's tokens each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus.token_sizes(docs).join(docs.select("doc_id", F.col("source").alias("shard")), "doc_id").groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))


@query(f"WITH {_SHARDS_OF} SELECT doc_id, start_pos, shard, start_pos - (end_pos - tokens) AS offset_in_shard FROM n JOIN e ON start_pos >= end_pos - tokens AND start_pos < end_pos")
def position_to_uneven_shard(spark, sf_dir):
    return corpus.located(corpus.token_offsets(_docs(spark, sf_dir)), _source_shards(spark, sf_dir)).select("doc_id", "start_pos", "shard", "offset_in_shard")


@query("SELECT source AS sample, count(n_chars) AS n, count(DISTINCT n_chars) AS n_distinct, count(n_chars) = count(DISTINCT n_chars) AS ok FROM documents GROUP BY 1")
def distinct_starts(spark, sf_dir):
    return metrics.distinct_check(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("sample"), "n_chars"), "sample", "n_chars")


@query("WITH s AS (SELECT source || '/' || lang AS sample, count(*) AS n, count(DISTINCT n_chars) AS u, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1) SELECT sample, CASE WHEN length(sample) % 5 = 0 THEN 'length' WHEN n % 7 = 0 THEN 'count' WHEN n <> u THEN 'repeated' WHEN hi + 64 >= 20000 THEN 'outside' END AS fault FROM s")
def evaluation_start_faults(spark, sf_dir):
    """Each source and language is a sample, a document's length a start."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws("/", "source", "lang").alias("sample"), F.col("n_chars").alias("start_token"))
    samples = rows.groupBy("sample").agg((F.count("*") + F.when(F.count("*") % 7 == 0, 1).otherwise(0)).alias("block_count"))
    samples = samples.withColumn("sequence_length", F.when(F.length("sample") % 5 == 0, 32).otherwise(64))
    return metrics.start_faults(rows, samples, 20_000, 64)


_ODD_NAMES = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'run-' || page_id || '.v1' WHEN 2 THEN '_run' || page_id WHEN 3 THEN '..' WHEN 4 THEN '' ELSE 'run ' || page_id END"


@query(f"WITH n AS (SELECT page_id, {_ODD_NAMES} AS name FROM pages) SELECT page_id, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]*') AS safe, name <> '' AND NOT contains(name, '/') AND name NOT IN ('.', '..') AS plain FROM n")
def name_checks(spark, sf_dir):
    name = F.expr(_ODD_NAMES)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *(c.alias(k) for k, c in metrics.name_checks(name).items()))


_RUN_NAMES = "CASE WHEN event_id % 3 = 0 THEN '35m_' ELSE '' END || event_type || '_mix_' || CASE event_id % 4 WHEN 0 THEN '100m' WHEN 1 THEN '300m' ELSE '1b' END || CASE WHEN event_id % 5 = 0 THEN '_muon_lr_2' ELSE '' END"


@query(f"WITH n AS (SELECT DISTINCT {_RUN_NAMES} AS run FROM events), c AS (SELECT run, replace(split_part(CASE WHEN starts_with(run, '35m_') THEN run[5:] ELSE run END, '_muon_', 1), '_', ' ') AS t FROM n) SELECT run, upper(t[1]) || lower(t[2:]) AS label FROM c")
def run_name_labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_RUN_NAMES).alias("run")).distinct().select("run", metrics.run_label(F.col("run")).alias("label"))


_VARIANTS = "event_type || '_' || CASE user_id % 4 WHEN 0 THEN '100m' WHEN 1 THEN '300m' WHEN 2 THEN '42m' ELSE '1b' END"


@query(f"WITH v AS (SELECT DISTINCT 'run' || user_id % 8 AS run, {_VARIANTS} AS variant FROM events), m AS (SELECT *, split_part(variant, '_', 1) AS mix, CASE WHEN ends_with(variant, '1b') THEN 1000 ELSE regexp_extract(variant, '_(\\d+)m$', 1)::INT END AS millions FROM v) SELECT *, row_number() OVER (PARTITION BY mix ORDER BY millions, variant, run) AS place FROM m")
def runs_by_size(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("run"), (F.col("user_id") % 8).cast("string")).alias("run"), F.expr(_VARIANTS).alias("variant")).distinct()
    return metrics.run_order(rows)


_TAGGED = "CASE event_id % 5 WHEN 0 THEN 'train/loss' WHEN 1 THEN 'validation/loss' WHEN 2 THEN 'gradient_groups/norms' WHEN 3 THEN 'gradient_groups/' ELSE 'train/other' END"


@query(f"SELECT {_TAGGED} AS tag, {_TAGGED} IN ('train/loss', 'validation/loss', 'gradient_groups/norms') AS known, count(*) AS n FROM events GROUP BY ALL")
def metric_tags(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_TAGGED).alias("tag"))
    return rows.groupBy("tag", metrics.known_tag(F.col("tag")).alias("known")).agg(F.count("*").alias("n"))


@query(f"WITH n AS (SELECT {_RUN_NAMES} AS run, {_TAGGED} AS tag, event_id AS step, value FROM events), c AS (SELECT *, replace(split_part(CASE WHEN starts_with(run, '35m_') THEN run[5:] ELSE run END, '_muon_', 1), '_', ' ') AS t FROM n WHERE tag IN ('train/loss', 'validation/loss')) SELECT upper(t[1]) || lower(t[2:]) AS label, tag, step, value FROM c")
def plotted_series(spark, sf_dir):
    """The filter is the feature: a figure shows two tags."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_RUN_NAMES).alias("run"), F.expr(_TAGGED).alias("tag"), F.col("event_id").alias("step"), "value")
    return metrics.plotted_series(rows, ["train/loss", "validation/loss"])


@query("SELECT '{\"run\":\"' || event_type || '\",\"steps\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS json FROM events GROUP BY event_type")
def results_json(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("steps"), F.count_distinct("user_id").alias("users"))
    return metrics.as_json(rows.withColumn("error", F.lit(None).cast("string")))


@query(f"WITH {_S} SELECT run, round(sum(value * step) / sum(step), 6) AS loss FROM s GROUP BY run")
def caller_loss(spark, sf_dir):
    """A caller's own loss, over whole runs."""
    return _rounded(metrics.reduced(_series(spark, sf_dir), lambda rows: (rows["value"] * rows["step"]).sum() / rows["step"].sum(), "run"))


@query(f"WITH e AS (SELECT doc_id, ['', chr(8195), chr(160), chr(28) || chr(32), chr(133) || chr(12288)][doc_id % 5 + 1] AS pad, {_TRIM} AS t FROM documents) SELECT doc_id, length(pad || t || pad) AS padded, length(t) AS n_chars, sha256(t) AS digest FROM e")
def unicode_strip(spark, sf_dir):
    """Texts between white space of five kinds, four of them not ASCII's usual."""
    pads = F.lit(["", "\u2003", "\u00a0", "\x1c ", "\x85\u3000"])
    rows = _docs(spark, sf_dir).select("doc_id", F.get(pads, (F.col("doc_id") % 5).cast("int")).alias("pad"), F.trim(F.col("text"), F.lit(" \t\n\r")).alias("t"))
    rows = rows.select("doc_id", F.concat("pad", "t", "pad").alias("text")).select("doc_id", F.length("text").alias("padded"), strip(F.col("text")).alias("t"))
    return rows.select("doc_id", F.col("padded").cast("long").alias("padded"), F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("digest"))


# Schedules, losses and array kernels.

_STEPS, _WARM = 2_000, 100
_REST = _STEPS - _WARM


_COSINE = f"CASE WHEN step <= {_WARM} THEN step / {_WARM} ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (step - 1 - {_WARM}) / {_REST - 1}))) END"


@query(f"WITH {_S} SELECT run, step, round({_COSINE}, 9) AS multiplier, round(0.0024 * 0.25 * {_COSINE}, 9) AS norm_rate, round(0.0024 * 0.4 * {_COSINE}, 9) AS muon_rate FROM s")
def lr_schedule_cosine(spark, sf_dir):
    """The rates at every logged step; after the schedule's end they stay at the least."""
    m = numeric.lr_multiplier(F.col("step") - 1, _STEPS, _WARM, "cosine", 0.1)
    rates = metrics.group_rates(m, 0.0024, 0.25, 0.4)
    return _series(spark, sf_dir).select("run", "step", F.round(m, 9).alias("multiplier"), *(F.round(rates[k], 9).alias(k) for k in ("norm_rate", "muon_rate")))


@query(f"WITH {_S} SELECT run, step, round(CASE WHEN step <= {_WARM} THEN step / {_WARM} WHEN step - 1 < {_STEPS - _REST // 2} THEN 1 ELSE 1 - 0.9 * least(1, (step - 1 - {_STEPS - _REST // 2}) / {_REST // 2 - 1}) END, 9) AS multiplier FROM s")
def lr_schedule_wsd(spark, sf_dir):
    m = numeric.lr_multiplier(F.col("step") - 1, _STEPS, _WARM, "wsd", 0.1, 0.5)
    return _series(spark, sf_dir).select("run", "step", F.round(m, 9).alias("multiplier"))


_LSE = "list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))"


@query(f"WITH {_E} SELECT vec_id, round({_LSE} - v[label + 1], 6) AS loss FROM e")
def cross_entropy(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(numeric.cross_entropy(F.col("v"), F.col("label")), 6).alias("loss"))


@query(f"WITH {_E}, l AS (SELECT {_LSE} AS z, {_LSE} - v[label + 1] AS ce FROM e) SELECT round(avg(z * z), 6) AS z_loss, round(avg(ce), 6) AS loss, round(avg(ce) + 1e-4 * avg(z * z), 6) AS objective FROM l")
def z_loss(spark, sf_dir):
    z, ce = F.avg(numeric.z_loss(F.col("v"))), F.avg(numeric.cross_entropy(F.col("v"), F.col("label")))
    return _logits(spark, sf_dir).agg(F.round(z, 6).alias("z_loss"), F.round(ce, 6).alias("loss"), F.round(ce + 1e-4 * z, 6).alias("objective"))


@query(f"WITH {_E}, b AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN i IN (1, 2, 4) THEN NULL ELSE x / 0.8 END) AS s FROM e), w AS (SELECT vec_id, list_transform(s, lambda x: coalesce(exp(x - list_max(s)), 0)) AS w FROM b) SELECT vec_id, round(list_max(w) / list_sum(w), 6) AS top, round(w[3] / list_sum(w), 6) AS third, w[1] = 0 AS blocked FROM w")
def softmax_temperature(spark, sf_dir):
    p = numeric.softmax(numeric.masked(F.col("v"), [0, 1, 3]), 0.8)
    return _logits(spark, sf_dir).select("vec_id", p.alias("p")).select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.element_at("p", 3), 6).alias("third"), (F.element_at("p", 1) == 0).alias("blocked"))


@query(f"WITH {_E} SELECT vec_id, len(list_filter(v, lambda x: x >= list_sort(v, 'DESC')[10])) AS kept, round(list_sort(v, 'DESC')[10], 6) AS cutoff FROM e")
def topk_mask(spark, sf_dir):
    kept = F.array_compact(numeric.top_k(F.col("v"), 10))
    return _logits(spark, sf_dir).select("vec_id", kept.alias("k")).select("vec_id", F.size("k").cast("long").alias("kept"), F.round(F.array_min("k"), 6).alias("cutoff"))


@query(f"WITH {_E}, r AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN i % 2 = 1 THEN x * cos(vec_id % 50 * pow(10000.0, -2.0 * ((i - 1) // 2) / 64)) - v[i + 1] * sin(vec_id % 50 * pow(10000.0, -2.0 * ((i - 1) // 2) / 64)) ELSE v[i - 1] * sin(vec_id % 50 * pow(10000.0, -2.0 * ((i - 1) // 2) / 64)) + x * cos(vec_id % 50 * pow(10000.0, -2.0 * ((i - 1) // 2) / 64)) END) AS r FROM e) SELECT vec_id, round(r[1], 5) AS first, round(r[2], 5) AS second, round(r[64], 5) AS last, round(list_sum(r), 5) AS total FROM r")
def rope_rotate(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("vec_id", numeric.rope(F.col("v"), F.col("vec_id") % 50).alias("r"))
    return rows.select("vec_id", *(F.round(F.element_at("r", i), 5).alias(n) for i, n in ((1, "first"), (2, "second"), (64, "last"))), F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {_E} SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64 + 1e-6), 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS norm, round(least(1, 1 / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-6)), 6) AS clip FROM e")
def rms_norm(spark, sf_dir):
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return _logits(spark, sf_dir).select("vec_id", F.round(F.element_at(numeric.rms_norm(F.col("v")), 1), 6).alias("first"), F.round(norm, 5).alias("norm"), F.round(numeric.clip_factor(norm, 1.0), 6).alias("clip"))


@query(f"WITH {_E}, c AS (SELECT vec_id, list_transform(v, lambda x, i: x + 0.1 * coalesce(CASE WHEN i > 3 THEN v[i - 3] END, 0) + 0.2 * coalesce(CASE WHEN i > 2 THEN v[i - 2] END, 0) + 0.3 * coalesce(CASE WHEN i > 1 THEN v[i - 1] END, 0) + 0.4 * x) AS c FROM e) SELECT vec_id, round(c[1], 6) AS first, round(c[4], 6) AS fourth, round(c[64], 6) AS last FROM c")
def causal_conv(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("vec_id", numeric.causal_convolution(F.col("v"), [0.1, 0.2, 0.3, 0.4]).alias("c"))
    return rows.select("vec_id", *(F.round(F.element_at("c", i), 6).alias(n) for i, n in ((1, "first"), (4, "fourth"), (64, "last"))))


@query(f"WITH {_E} SELECT vec_id, round(v[1] / (1 + exp(-v[1])) * v[33], 6) AS first FROM e")
def swiglu(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(F.element_at(numeric.swiglu(F.slice("v", 1, 32), F.slice("v", 33, 32)), 1), 6).alias("first"))


@query(f"SELECT doc_id, length({_TRIM}) AS n_chars, strlen({_TRIM}) AS n_ids, sha256({_TRIM}) AS digest FROM documents")
def stripped_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", strip(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.size(byte_ids(F.col("t"))).cast("long").alias("n_ids"), F.sha2(F.col("t").cast("binary"), 256).alias("digest"))


@query(f"WITH {_S}, l AS (SELECT run, max(step) AS last FROM s GROUP BY run) SELECT run, step, step % 20 = 0 OR step = last AS validates, step % 50 = 0 AND step <> last AS saves, step = 1 OR step = last OR step % 100 = 0 AS diagnoses FROM s JOIN l USING (run)")
def event_steps(spark, sf_dir):
    return progress.event_steps(_series(spark, sf_dir), 20, 50, 100)


@query("""WITH p AS (SELECT event_id, event_id // 40 AS epoch, event_id % 40 AS next_batch, event_id // 40 * 10 + event_id % 40 // 4 + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS global_step FROM events),
q AS (SELECT *, global_step * 64 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS tokens_seen FROM p)
SELECT event_id, CASE WHEN global_step < 0 OR global_step > 2000 THEN 'step' WHEN next_batch % 4 <> 0 OR next_batch >= 40 THEN 'cursor' WHEN global_step <> epoch * 10 + next_batch // 4 THEN 'position' WHEN tokens_seen <> global_step * 64 THEN 'tokens' END AS fault FROM q""")
def progress_invariants(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.col("event_id") / 40).alias("epoch"), (F.col("event_id") % 40).alias("next_batch"), "user_id")
    rows = rows.withColumn("global_step", F.col("epoch") * 10 + F.floor(F.col("next_batch") / 4) + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0))
    rows = rows.withColumn("tokens_seen", F.col("global_step") * 64 + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).withColumn("clipped_steps", F.lit(0))
    return progress.progress_faults(rows, steps_per_epoch=10, accumulation=4, tokens_per_step=64, total=2000).select("event_id", "fault")


@query(f"""WITH {_E}, b AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x >= list_sort(v, 'DESC')[10] THEN exp((x - list_max(v)) / 0.8) ELSE 0 END) AS w FROM e),
p AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM b), c AS (SELECT vec_id, unnest(range(1, 65)) AS i, p FROM p)
SELECT vec_id, min(i) - 1 AS token FROM c WHERE list_sum(p[1:i]) > (vec_id * 7919 % 1000 + 0.5) / 1000 GROUP BY vec_id""")
def multinomial_draw(spark, sf_dir):
    p = numeric.softmax(numeric.top_k(F.col("v"), 10), 0.8)
    return _logits(spark, sf_dir).select("vec_id", p.alias("p")).select("vec_id", draw(F.col("p"), (F.col("vec_id") * 7919 % 1000 + 0.5) / 1000).cast("long").alias("token"))


@query()
def subword_corpus_stats(spark, sf_dir):
    """Tokens are a library's, which SQL has not; a test holds their number against it."""
    return corpus.corpus_stats(_docs(spark, sf_dir), _piece_model())


@query()
def subword_measures(spark, sf_dir):
    return token_measures(_docs(spark, sf_dir), _piece_model())


@query(f"SELECT doc_id, length({_TRIM}) AS n_chars, sha256({_TRIM}) AS digest FROM documents WHERE length({_TRIM}) > 0")
def subword_round_trip(spark, sf_dir):
    """Texts that were encoded and decoded again: the same, but that this model's decoder drops one space at the start."""
    docs = _docs(spark, sf_dir)
    back = decoded(encoded(docs, _piece_model()), _piece_model())
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def _piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query()
def sentencepiece_tokens(spark, sf_dir):
    """A test holds the ids against the library on the driver."""
    rows = framed_tokens(_docs(spark, sf_dir), _piece_model())
    return _digests(rows.select("doc_id", (F.octet_length("raw") / 2).cast("long").alias("n_tokens"), F.col("raw").alias("digest")), "digest")
