"""Documents as a stream: framed tokens of what is new, with a cursor in the checkpoint folder."""

from __future__ import annotations

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.corpus import framed_bytes, prefix, token_stream
from granary.sources.files import exists, read_json, store

#: Columns of documents; where ids are of another type, a stream is given a schema of its own, with doc_id and text at least.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_REACHED = "granary: the token target is reached"


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 64, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 64, schema: str = DOCUMENTS) -> None:
    """Frames all documents that came since the last call, and ends; a batch that is tried again is written once."""
    framed = framed_bytes(document_stream(spark, folder, files_per_batch, schema))
    framed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _cursor(out: str, batch: int) -> str:
    return f"{out.rstrip('/')}/_cursor/{batch:09d}.json"


def ingest_prefix(spark: SparkSession, folder: str, out: str, checkpoint: str, target: int, *, files_per_batch: int = 1, proto: bytes | None = None, schema: str = DOCUMENTS) -> dict:
    """Takes files as they came, `files_per_batch` at a time, until the stream has `target` tokens; gives back the cursor.

    The cursor says how many tokens lie in `out`, the last document used, how many of its tokens, and whether the target is
    reached. Order is that of the files, and of doc_id within a batch. The batch that crosses the target stays open: a call
    with a larger target takes it up again, and writes it anew, before it reads another file; files after it are never
    opened. A call that was cut off goes on in the same way. One budget holds for all tasks: it is the count of the batch
    before, which the batch before wrote with its tokens.
    """
    if target < 1:
        raise ValueError("a target over 0")
    files, place = store(out)
    files.create_dir(f"{place}/_cursor", recursive=True)

    def take(rows: DataFrame, batch: int) -> None:
        before = read_json(_cursor(out, batch - 1))["whole"] if batch and exists(_cursor(out, batch - 1)) else 0
        if before >= target:
            raise RuntimeError(_REACHED)
        stream = token_stream(rows.select("doc_id", "text"), proto)
        kept = prefix(stream, target - before).withColumn("start_pos", F.col("start_pos") + before)
        kept.select("doc_id", "start_pos", "n_tokens", "raw").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch:09d}")
        found = stream.agg(F.sum("n_tokens").alias("n"), F.max_by(F.struct("doc_id", "start_pos"), F.when(F.col("start_pos") < target - before, F.col("start_pos"))).alias("last")).first()
        whole = before + (found["n"] or 0)
        cursor = {"batch": batch, "before": before, "whole": whole, "tokens": min(whole, target), "complete": whole >= target}
        if found["last"] is not None:
            cursor |= {"last_doc": found["last"]["doc_id"], "last_doc_tokens": cursor["tokens"] - before - found["last"]["start_pos"]}
        with files.open_output_stream(store(_cursor(out, batch))[1]) as file:
            file.write(json.dumps(cursor, default=str).encode())
        if whole >= target:
            raise RuntimeError(_REACHED)

    query = document_stream(spark, folder, files_per_batch, schema).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as stopped:
        if _REACHED not in str(stopped):
            raise
    return last_cursor(out)


def last_cursor(out: str) -> dict:
    """The cursor of the last batch that was taken; without one, nothing was."""
    files, place = store(out)
    from pyarrow import fs

    names = sorted(info.base_name for info in files.get_file_info(fs.FileSelector(f"{place}/_cursor", allow_not_found=True)) if info.size)
    return read_json(f"{out.rstrip('/')}/_cursor/{names[-1]}") if names else {"batch": -1, "before": 0, "whole": 0, "tokens": 0, "complete": False}


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start_pos, n_tokens, raw of the batches that have a cursor."""
    return spark.read.parquet(out).filter(F.col("batch") <= last_cursor(out)["batch"]).drop("batch")
