"""python -m granary build | count | sample | validate | check | smoke; documents are Parquet tables (doc_id, text)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from granary.operators import artifacts, corpus
from granary.sources import settings


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="granary", description=__doc__)
    commands = own.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *names: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=about)
        for n in names:
            command.add_argument(n)
        return command

    build = add("build", "write token artifacts, all prefixes of one stream", "documents", "output")
    build.add_argument("--target", action="append", required=True, metavar="NAME=TOKENS")
    build.add_argument("--shard-tokens", type=int, default=50_000_000)
    build.add_argument("--dataset-revision")
    build.add_argument("--overwrite", action="store_true")
    count = add("count", "documents, characters, words and tokens", "documents")
    count.add_argument("--sample-docs", type=int, help="the first documents alone")
    sample = add("sample", "the texts that a tokenizer's training would read", "documents", "output")
    sample.add_argument("--byte-budget", type=int, default=1 << 30)
    for command in (build, count):
        command.add_argument("--tokenizer", help="a sentencepiece model; without one, a token a byte")
    add("validate", "checks of artifacts, a line each", "root").add_argument("artifact", nargs="+")
    check = add("check", "a run's settings, with all defaults", "config")
    check.add_argument("--override", action="append", default=[])
    check.add_argument("--extends", action="append", default=[])
    add("smoke", "whether Spark and its Python workers run here")
    return own


def smoke(spark: SparkSession) -> DataFrame:
    """check, ok, detail: a shuffle, Arrow batches to Python workers, and a Parquet-free round trip of 16-bit ids."""
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "doc_id long, text string")
    total = docs.groupBy((docs.doc_id % 3).alias("k")).count().count()
    blocks = corpus.blocks(corpus.token_stream(docs), 8).count()
    rows = [("shuffle", total == 3, f"{total} groups"), ("arrow", blocks > 0, f"{blocks} blocks"), ("version", spark.version >= "4", spark.version)]
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def main(args: Sequence[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "check":
        print(settings.Settings.load(given.config, given.override, given.extends).to_toml())
        return 0
    spark = SparkSession.builder.appName(f"granary-{given.command}").getOrCreate()
    if given.command in ("smoke", "validate"):
        rows = (smoke(spark) if given.command == "smoke" else artifacts.artifact_checks(spark, given.root, given.artifact)).collect()
        print("\n".join(f"{'ok ' if r['ok'] else 'BAD'} {' '.join(map(str, r))}" for r in rows))
        return int(not all(r["ok"] for r in rows))
    docs = spark.read.parquet(given.documents).select("doc_id", "text")
    if given.command == "sample":
        corpus.byte_budget_sample(docs, given.byte_budget, with_text=True).write.parquet(given.output)
        return 0
    proto = Path(given.tokenizer).read_bytes() if given.tokenizer else None
    if given.command == "count":
        stats = corpus.corpus_stats(corpus.first_documents(docs, given.sample_docs) if given.sample_docs else docs, proto)
        print(json.dumps(stats.first().asDict() | corpus.token_ratios(stats).first().asDict()))
        return 0
    targets = {name: int(n) for name, _, n in (t.partition("=") for t in given.target)}
    extras = {"dataset": {"revision": given.dataset_revision}} if given.dataset_revision else {}
    made = artifacts.build_artifacts(docs, given.output, targets, given.shard_tokens, overwrite=given.overwrite, proto=proto, **extras)
    print(json.dumps({name: {"tokens": r["token_count"], "shards": len(r["shards"])} for name, r in made.items()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
