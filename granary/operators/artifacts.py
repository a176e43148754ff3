"""Token artifacts: shard files of 16-bit ids with a metadata record; writing, reading back, validation and identity."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.corpus import prefix, shard_pieces, token_offsets, token_stream
from granary.sources.files import exists, read_json, sizes
from granary.sources.shards import STORAGE, file_digests, shard_file, write_shards

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\Z")


def uint16_bytes(ids) -> bytes:
    values = np.asarray(ids, np.int64)
    if len(values) and (values.min() < 0 or values.max() > 0xFFFF):
        raise ValueError("token ids must fit 16 bits")
    return values.astype("<u2").tobytes()


def shard_manifest(stream: DataFrame, size: int) -> DataFrame:
    """shard, file, tokens, bytes, sha256 of each shard; pieces come to a task in order and go to the digest one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, n = None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                columns = [pa.array([at], pa.int64()), pa.array([shard_file(at)]), pa.array([n // 2], pa.int64()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "file", "tokens", "bytes", "sha256"])

        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != at:
                    yield from done()
                    at, digest, n = number, hashlib.sha256(), 0
                piece = raw.as_buffer()
                digest.update(piece)
                n += piece.size
        yield from done()

    pieces = shard_pieces(stream, size).repartition("shard").sortWithinPartitions("shard", "from_pos")
    return pieces.select("shard", "raw").mapInArrow(run, "shard long, file string, tokens long, bytes long, sha256 string")


def publish(stream: DataFrame, root: str, name: str, size: int, *, overwrite: bool = False, **extras) -> dict:
    """Writes an artifact under root, a path or URI that driver and executors reach, and gives back its record.

    An old artifact of the name stands until the new one is whole; see ShardWriter.
    """
    if not _NAME.match(name) or size < 1:
        raise ValueError(f"not a name of an artifact and a shard size over 0: {name!r}, {size}")
    final = f"{root.rstrip('/')}/{name}"
    if exists(final) and not overwrite:
        raise FileExistsError(f"{final} exists; overwrite=True replaces it")
    if stream.isEmpty():
        raise ValueError("the stream has no tokens")
    write_shards(shard_pieces(stream, size), final, size, overwrite=overwrite, **extras)
    return read_json(f"{final}/metadata.json")


def build_artifacts(docs: DataFrame, root: str, targets: dict[str, int], size: int, *, overwrite: bool = False, proto: bytes | None = None, **extras) -> dict[str, dict]:
    """One artifact for each named target, all prefixes of one stream; fails before it writes any if the stream is shorter than the largest.

    proto: a sentencepiece model; without one, an id a byte. What each prefix holds comes from sizes alone.
    """
    for name in targets:
        if exists(final := f"{root.rstrip('/')}/{name}") and not overwrite:
            raise FileExistsError(f"{final} exists")
    offsets = token_offsets(docs, proto)
    total = offsets.agg(F.sum("n_tokens")).first()[0] or 0
    if total < max(targets.values()):
        raise ValueError(f"the documents have {total} tokens; {max(targets.values())} are wanted")
    ends = {n: prefix(offsets, t).agg(F.max(F.col("start_pos") + F.col("n_tokens"))).first()[0] for n, t in targets.items()}
    ordered, out, stream = sorted(targets, key=targets.get), {}, token_stream(docs, proto)
    for name, larger in zip(ordered, [*ordered[1:], None], strict=True):
        about = {"target_token_count": targets[name], "ends_at_document_boundary": ends[name] == targets[name], "is_prefix_of": larger}
        out[name] = publish(prefix(stream, targets[name]), root, name, size, overwrite=overwrite, **about, **extras)
    return out


def inventory_faults(declared: DataFrame, found: DataFrame) -> DataFrame:
    """file, fault (missing, extra or size) over (file, bytes) of the record and of the folder."""
    d, f = declared.select("file", F.col("bytes").alias("declared")), found.select("file", F.col("bytes").alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("declared").isNull(), "extra").when(F.col("found") != F.col("declared"), "size")
    return d.join(f, "file", "full_outer").select("file", fault.alias("fault")).filter("fault is not null")


def _whole(value) -> bool:
    return type(value) is int


def record_checks(record: dict, sizes: dict[str, int]) -> list[tuple[str, bool, str]]:
    """(check, ok, detail) of a record, given the names and sizes of the folder's files."""
    count, listed = record.get("token_count"), record.get("shards")
    shards = [s for s in listed if isinstance(s, dict)] if isinstance(listed, list) else []
    names = [s.get("file") for s in shards]
    declared = {s.get("file"): s.get("bytes") for s in shards}
    plain = lambda n: isinstance(n, str) and n != "" and os.path.basename(n) == n
    wrong = [f"size of {n!r} is {sizes[n]}, declared {size}" for n, size in declared.items() if n in sizes and sizes[n] != size]
    lost = [n for n in declared if n not in sizes]
    extra = sorted({n for n in sizes if n.startswith("tokens-") and n.endswith(".bin")} - set(declared))
    total = sum(b for b in declared.values() if _whole(b))
    return [
        ("token_count", _whole(count) and count > 0, f"token_count must be a positive integer: {count!r}"),
        ("shards", bool(shards) and len(shards) == len(listed), f"{len(shards)} shards are listed"),
        ("names", all(map(plain, names)), f"not plain file names: {[n for n in names if not plain(n)]}"),
        ("unique", len(set(map(str, names))) == len(names), f"listed again: {[n for n, k in Counter(map(str, names)).items() if k > 1]}"),
        ("byte_counts", all(_whole(b) for b in declared.values()), f"not byte counts: {[b for b in declared.values() if not _whole(b)]}"),
        ("sizes", not wrong, "; ".join(wrong)),
        ("inventory", not lost and not extra, f"shard inventory: missing {lost}, not listed {extra}"),
        ("total", not _whole(count) or total == 2 * count, f"{count} tokens need {2 * count if _whole(count) else None} bytes; {total} are listed"),
    ]


def reader_checks(record: dict, sizes: dict[str, int], length: int) -> list[tuple[str, bool, str]]:
    """(check, ok, detail) of what reading blocks of `length` needs: storage, files of the right size, tokens enough, a sound sample."""
    storage, shards = record.get("storage") or {}, record.get("shards") or []
    files = [(s.get("file"), s.get("tokens")) for s in shards]
    total = sum(n for _, n in files if _whole(n))
    sample = record.get("fixed_evaluation_sample")
    blocks = (sample or {}).get("blocks") or []
    starts = [b.get("start_token") for b in blocks]
    inside = all(_whole(x) and 0 <= x and x + length < total for x in starts)
    return [
        ("storage", {k: storage.get(k) for k in STORAGE} == STORAGE, f"storage must be {STORAGE}, not {storage}"),
        ("length", length > 0 and bool(shards), "a block length over 0 and a shard are needed"),
        ("files", all(n in sizes for n, _ in files), f"shards not found: {[n for n, _ in files if n not in sizes]}"),
        ("sizes", all(sizes.get(n, 2 * (k or 0)) == 2 * (k or 0) for n, k in files), f"shards must have 2 bytes a token: {[(n, sizes.get(n), k) for n, k in files if n in sizes and sizes[n] != 2 * (k or 0)]}"),
        ("total", total == record.get("token_count"), f"the shards have {total} tokens; the record says {record.get('token_count')}"),
        ("blocks", total > length, "the artifact is too small for one block"),
        ("sample_length", sample is None or sample.get("sequence_length") == length, "the evaluation sample has another sequence length"),
        ("sample_starts", sample is None or bool(starts) and sample.get("block_count") == len(set(starts)) == len(starts) and inside, "the evaluation sample's starts must be new, whole and inside the stream"),
    ]


def opened(directory: str) -> tuple[dict, dict[str, int]]:
    """An artifact's record, and its folder's files with their sizes."""
    try:
        return read_json(f"{directory.rstrip('/')}/metadata.json"), sizes(directory)
    except json.JSONDecodeError as bad:
        raise ValueError(f"the record in {directory} is not JSON: {bad}") from bad


def artifact_checks(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """artifact, check, ok, detail (empty where ok) for each wanted artifact under root; one that can't be opened has the check "record" alone."""
    rows = []
    for name in names:
        try:
            rows += [(name, check, ok, "" if ok else detail) for check, ok, detail in [("record", True, ""), *record_checks(*opened(f"{root.rstrip('/')}/{name}"))]]
        except (OSError, ValueError) as bad:
            rows.append((name, "record", False, str(bad)))
    return spark.createDataFrame(rows, "artifact string, check string, ok boolean, detail string")


def validate(directory: str, *, check_digests: bool = False, spark: SparkSession | None = None) -> tuple[int, int]:
    """Tokens and bytes of a sound artifact; else raises with all faults. Digests are checked on the executors, where asked for."""
    record, sizes = opened(directory)
    if found := [detail for _, ok, detail in record_checks(record, sizes) if not ok]:
        raise ValueError(f"{directory}: " + "; ".join(found))
    if check_digests:
        own = {r["file"]: r["sha256"] for r in file_digests(spark, directory, "tokens-*.bin").collect()}
        if wrong := [s["file"] for s in record["shards"] if own[s["file"]] != s["sha256"]]:
            raise ValueError(f"{directory}: digests differ: {wrong}")
    return record["token_count"], 2 * record["token_count"]


def identity(record: dict) -> str:
    """SHA-256 of what makes an artifact the same data wherever it lies: canonical JSON of storage, tokenizer, counts and shard digests."""
    tokenizer = record.get("tokenizer") or {}
    if not tokenizer.get("sha256") or not all(isinstance(s.get("sha256"), str) and s["sha256"] for s in record["shards"]):
        raise ValueError("the tokenizer's and every shard's SHA256 are needed")
    own = {
        "fixed_evaluation_sample": record.get("fixed_evaluation_sample"), "shards": [{"sha256": s["sha256"], "tokens": s["tokens"]} for s in record["shards"]], "storage": record["storage"],
        "token_count": record["token_count"], "tokenizer_sha256": tokenizer["sha256"], "vocab_size": tokenizer.get("vocab_size"),
    }
    return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


def identities(shards: DataFrame, artifacts: DataFrame) -> DataFrame:
    """artifact, identity: as identity(), over (artifact, shard, tokens, sha256) and (artifact, tokenizer_sha256, vocab_size) rows, no sample.

    The JSON is written by column functions; a shard's part is of fixed size, and an artifact has some thousand shards.
    """
    part = F.format_string('{"sha256": "%s", "tokens": %d}', "sha256", "tokens")
    listed = shards.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("shard", part.alias("part")))).alias("parts"), F.sum("tokens").alias("count"))
    storage = json.dumps(STORAGE, sort_keys=True).replace("%", "%%")
    text = F.format_string(
        '{"fixed_evaluation_sample": null, "shards": [%s], "storage": ' + storage + ', "token_count": %d, "tokenizer_sha256": "%s", "vocab_size": %d}',
        F.array_join(F.transform("parts", lambda p: p["part"]), ", "), "count", "tokenizer_sha256", "vocab_size",
    )
    return listed.join(artifacts, "artifact").select("artifact", F.sha2(text.cast("binary"), 256).alias("identity"))


def compatibility(train: DataFrame, validation: DataFrame, vocab_size: int) -> DataFrame:
    """artifact, ok, detail for each train artifact (artifact, tokenizer_sha256, vocab_size) against the validation data of its name."""
    held = validation.select("artifact", F.col("tokenizer_sha256").alias("other_sha"), F.col("vocab_size").alias("other_size"))
    detail = (
        F.when(F.col("other_sha").isNull() & F.col("other_size").isNull(), "no validation data")
        .when(~F.coalesce(F.col("tokenizer_sha256") == F.col("other_sha"), F.lit(False)), "tokenizers differ")
        .when(~F.coalesce((F.col("vocab_size") == vocab_size) & (F.col("other_size") == vocab_size), F.lit(False)), "vocabulary size differs from the model's")
        .otherwise("")
    )
    return train.join(held, "artifact", "left").select("artifact", (detail == "").alias("ok"), detail.alias("detail"))


def compatible(train: dict, validation: dict, vocab_size: int) -> None:
    a, b = train.get("tokenizer") or {}, validation.get("tokenizer") or {}
    if not a.get("sha256") or a.get("sha256") != b.get("sha256"):
        raise ValueError("train and validation data must use the same tokenizer")
    if a.get("vocab_size") != vocab_size or b.get("vocab_size") != vocab_size:
        raise ValueError("the data's vocabulary size differs from the model's")
