"""Folders by path or URI, as tasks and driver alike reach them, and tables that cut a plan's lineage."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:, hdfs:, s3:, gs: ...), and the place in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), os.path.abspath(path)


def sizes(path: str) -> dict[str, int]:
    """The files of a folder, not of those below, with their sizes."""
    files, place = store(path)
    return {info.base_name: info.size for info in files.get_file_info(fs.FileSelector(place)) if info.is_file}


def exists(path: str) -> bool:
    files, place = store(path)
    return files.get_file_info(place).type != fs.FileType.NotFound


def read_json(path: str):
    files, place = store(path)
    with files.open_input_stream(place) as file:
        return json.loads(file.read().decode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's checkpoint folder; a local master may have one of the machine's own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and what is lost is read, not worked out anew."""
    path = f"{shared_dir(df.sparkSession)}/granary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
