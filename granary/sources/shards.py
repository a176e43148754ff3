"""Shard files of 16-bit ids: written by tasks, put in place by one commit; and digests of files of any size."""

from __future__ import annotations

import contextlib
import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from granary.sources.files import sizes, store

#: The storage header of every artifact.
STORAGE = {"dtype": "uint16", "endianness": "little", "layout": "flat_token_stream"}
#: Where a task's files are until the commit, in the folder that becomes the artifact.
ATTEMPTS = "_attempts"
_READ = 1 << 20
#: Bytes of files that a task digests, and those that opening a file counts as beside its own.
TASK_BYTES, OPEN_BYTES = 64 << 20, 1 << 16


def shard_file(number: int) -> str:
    return f"tokens-{number:05d}.bin"


def metadata(manifest: list[dict], size: int, **extras) -> dict:
    """The record of an artifact, from (shard, file, tokens, bytes, sha256); extras come last and may replace its fields."""
    files = [{k: row[k] for k in ("file", "tokens", "bytes", "sha256")} for row in sorted(manifest, key=lambda row: row["shard"])]
    return {"format_version": 1, "storage": {**STORAGE, "shard_token_limit": size}, "token_count": sum(f["tokens"] for f in files), "shards": files, "document_encoding": ["BOS", "content", "EOS"], **extras}


@dataclass
class Written(WriterCommitMessage):
    """A task's shards: (number, tokens, SHA-256, name of the attempt's file)."""

    shards: list[tuple[int, int, str, str]]


class ShardWriter(DataSourceArrowWriter):
    """An artifact's folder by way of another beside it.

    Each attempt of a task writes files of its own names. The commit, on the driver, moves the files of the attempts that
    count, drops all others, adds the record and puts the folder in the place of the old one, which stands until then. A
    failed attempt drops its files, and the abort drops the whole folder, so whatever attempts fail, run twice or come late
    leaves nothing. Object stores rename by copying; others move.
    """

    def __init__(self, options, overwrite: bool):
        self.files_path = options["path"].rstrip("/")
        self.size, self.extras, self.overwrite = int(options["shardtokens"]), json.loads(options.get("record", "{}")), overwrite
        self.job = uuid.uuid4().hex
        files, place = self._open()
        files.create_dir(f"{place}/{ATTEMPTS}", recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str]:
        """The file system and the folder that the job writes to; `final` is where the commit puts it."""
        files, self.final = store(self.files_path)
        parent, _, name = self.final.rpartition("/")
        return files, f"{parent}/.{name}.{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """(shard, raw), each shard's pieces in a row and in order, go to digest and file one by one, so a shard of any size takes a batch's memory."""
        files, place = self._open()
        done, attempt, at, out, digest, n = [], uuid.uuid4().hex, None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                done[-1] = (at, n // 2, digest.hexdigest(), done[-1][3])

        try:
            for batch in iterator:
                for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if number != at:
                        close()
                        at, digest, n = number, hashlib.sha256(), 0
                        done.append((at, 0, "", f"{shard_file(number)}.{attempt}"))
                        out = files.open_output_stream(f"{place}/{ATTEMPTS}/{done[-1][3]}", compression=None)
                    piece = raw.as_buffer()
                    out.write(piece)
                    digest.update(piece)
                    n += piece.size
            close()
        except BaseException:
            if out is not None:
                with contextlib.suppress(OSError):
                    out.close()
            for *_, name in done:
                with contextlib.suppress(OSError):
                    files.delete_file(f"{place}/{ATTEMPTS}/{name}")
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, place = self._open()
        shards = sorted(shard for message in messages if message is not None for shard in message.shards)
        if not shards or [number for number, *_ in shards] != list(range(len(shards))):
            raise ValueError(f"shards must be 0, 1, ..., each from one task: {[number for number, *_ in shards][:20]}")
        if self.overwrite is False and files.get_file_info(self.final).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.files_path} exists; mode overwrite replaces it")
        for number, _, _, name in shards:
            files.move(f"{place}/{ATTEMPTS}/{name}", f"{place}/{shard_file(number)}")
        files.delete_dir(f"{place}/{ATTEMPTS}")
        manifest = [{"shard": number, "file": shard_file(number), "tokens": n, "bytes": 2 * n, "sha256": sha} for number, n, sha, _ in shards]
        with files.open_output_stream(f"{place}/metadata.json") as file:
            file.write((json.dumps(metadata(manifest, self.size, **self.extras), indent=2, sort_keys=True) + "\n").encode())
        old = f"{place}.old"
        stood = files.get_file_info(self.final).type != fs.FileType.NotFound
        if stood:
            files.move(self.final, old)
        try:
            files.move(place, self.final)
        except BaseException:
            if stood:
                files.move(old, self.final)
            raise
        if stood:
            files.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, place = self._open()
        if files.get_file_info(place).type != fs.FileType.NotFound:
            files.delete_dir(place)


class TokenShards(DataSource):
    """write.format("token_shards"): options path (a path or URI of the artifact), shardTokens, record (JSON of further fields of the record)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "shard long, raw binary"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def write_shards(pieces: DataFrame, path: str, size: int, *, overwrite: bool = False, **extras) -> None:
    """(shard, from_pos, raw) pieces to the artifact at path; all of a shard's pieces come to one task, in order."""
    pieces.sparkSession.dataSource.register(TokenShards)
    ordered = pieces.repartition("shard").sortWithinPartitions("shard", "from_pos").select("shard", "raw")
    ordered.write.format("token_shards").options(path=path, shardTokens=size, record=json.dumps(extras)).mode("overwrite" if overwrite else "append").save()


@dataclass
class Files(InputPartition):
    names: list[str]


class DigestReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*")

    def partitions(self) -> list[Files]:
        """Files in order of their names, TASK_BYTES together, so that tasks grow with the bytes, however small the files; a larger file is a task of its own."""
        found, held = [Files([])], 0
        for name, size in sorted(sizes(self.path).items()):
            if not fnmatch.fnmatchcase(name, self.pattern):
                continue
            if found[-1].names and held + size + OPEN_BYTES > TASK_BYTES:
                found.append(Files([]))
                held = 0
            found[-1].names.append(name)
            held += size + OPEN_BYTES
        return found

    def read(self, partition: Files) -> Iterator[tuple]:
        files, place = store(self.path)
        for name in partition.names:
            digest, n = hashlib.sha256(), 0
            with files.open_input_stream(f"{place}/{name}", compression=None) as file:
                while block := file.read(_READ):
                    digest.update(block)
                    n += len(block)
            yield name, n, digest.hexdigest()


class FileDigests(DataSource):
    """format("file_digests"): file, bytes, sha256 of a folder's files, read a mebibyte at a time; options path, pattern."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, bytes long, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


def file_digests(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """file, bytes, sha256 of the files of a folder, small ones together in a task; a file of any size takes a mebibyte of memory."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").options(path=directory, pattern=pattern).load()
