"""Orders over all tasks, interval joins, the shard writer and readers, against plain Python."""

import bisect
import hashlib
import os
import pickle
import random
import time
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from granary.functions.text import SPACES, strip
from granary.functions.tokenizer import with_ids
from granary.operators import artifacts, corpus, ordered
from granary.sources import shards
from granary.sources.files import sizes, store
from granary.sources.tokens import TokenBlockReader, read_blocks


def plan(df):
    return df._jdf.queryExecution().toString()


def test_strip_is_linear(spark):
    assert len(SPACES) == 29
    text = "a" + " " * 1_000_000 + "b"
    rows = spark.createDataFrame([(f"　\x1c {text} \n",)], "text string")
    assert rows.select(strip(F.col("text"))).first()[0] == text
    begin = time.time()
    assert rows.select((strip(F.col("text")) == F.lit("x")).alias("t")).first()[0] is False
    assert time.time() - begin < 1


@pytest.mark.parametrize("runs", [1, 2, 7])
def test_running_totals_over_any_ids(spark, runs):
    names = [None, "b", "a", "a", "aa", "B", "ä"] + [f"n{i % 40}" for i in range(200)]
    rows = [(n, random.Random(i).choice([None, 0, 1, 5]), i) for i, n in enumerate(names)]
    table = spark.createDataFrame(rows, "name string, n long, run int").repartition(5)
    found = sorted(ordered.running_total(table, "name", "n", "before", runs).collect(), key=lambda r: r["before"])
    assert sorted(r["run"] for r in found) == list(range(len(rows))) and found[0].__fields__ == ["name", "n", "run", "before"]
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0))
    plain = [(r[0], r[1], total - (r[1] or 0)) for r, total in zip(want, accumulate(r[1] or 0 for r in want))]
    assert sorted(map(str, plain)) == sorted(str((r["name"], r["n"], r["before"])) for r in found)


def test_streams_of_string_ids_are_the_plain_ones(spark):
    texts = {f"doc-{i:03}": "xy" * (i % 5) + " " * (i % 3) for i in range(90)} | {"zz": None, "": " first "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(6)
    ids = [x for key in sorted(texts) if (texts[key] or "").strip() for x in (1, *(7 + b for b in texts[key].strip().encode()), 2)]
    stream = corpus.token_stream(docs, runs=5)
    assert [x for r in with_ids(stream).orderBy("start_pos").collect() for x in r["ids"]] == ids
    offsets = {r["doc_id"]: r["start_pos"] for r in corpus.token_offsets(docs).collect()}
    assert offsets == {r["doc_id"]: r["start_pos"] for r in stream.collect()}
    blocks = {r["block_id"]: r["ids"] for r in with_ids(corpus.blocks(stream, 4)).collect()}
    assert blocks == {b: ids[4 * b : 4 * b + 5] for b in range((len(ids) - 1) // 4)}


@pytest.mark.parametrize("runs", [1, 3, 11])
def test_positions_find_their_shards(spark, runs):
    r = random.Random(runs)
    lengths = [r.choice([0, 1, 2, 30]) for _ in range(60)]
    ends = list(accumulate(lengths))
    table = spark.createDataFrame(list(enumerate(lengths)), "shard long, tokens long")
    at = [r.randrange(ends[-1] + 20) for _ in range(400)] + [0, ends[-1] - 1, ends[-1]] + [5] * 100 + [None]
    found = corpus.located(spark.createDataFrame([(i, p) for i, p in enumerate(at)], "id long, start_pos long").repartition(4), table, runs=runs)
    for row in found.collect():
        p = row["start_pos"]
        if p is None or p >= ends[-1]:
            assert row["shard"] is None and row["offset_in_shard"] is None
        else:
            shard = bisect.bisect_right(ends, p)
            assert (row["shard"], row["offset_in_shard"]) == (shard, p - (ends[shard - 1] if shard else 0))
    assert found.count() == len(at) and "NestedLoop" not in plan(found)
    assert {x["shard"]: x["end_pos"] for x in corpus.shard_ends(table).collect()} == dict(enumerate(ends))


def test_positions_before_any_shard_and_none_at_all(spark):
    rows = spark.createDataFrame([(3,)], "start_pos long")
    none = spark.createDataFrame([], "shard string, tokens long")
    assert corpus.located(rows, none).first().asDict() == {"start_pos": 3, "shard": None, "offset_in_shard": None}
    assert corpus.located(rows.limit(0), none).count() == 0


@pytest.mark.parametrize("width", [1, 4, 50])
def test_overlaps_are_all_pairs_once(spark, width):
    r = random.Random(width)
    make = lambda n: [(i, a, a + r.choice([0, 1, 3, 40])) for i, a in enumerate(r.randrange(120) for _ in range(n))]
    left, right = make(60), make(50)
    found = ordered.overlaps(spark.createDataFrame(left, "i long, a long, b long"), spark.createDataFrame(right, "j long, c long, d long"), ("a", "b"), ("c", "d"), width)
    want = sorted((i, j) for i, a, b in left for j, c, d in right if max(a, c) < min(b, d))
    assert sorted((x["i"], x["j"]) for x in found.collect()) == want and "NestedLoop" not in plan(found)


def test_evaluation_blocks_of_many_starts(spark):
    texts = ["abc", None, "x" * 300, "yz", "w" * 41, ""] + ["q" * (i % 7) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ids = [x for t in texts if t and t.strip() for x in (1, *(7 + b for b in t.encode()), 2)]
    starts = [0, 1, 2, 2, 5, 100, 101, 299, len(ids) - 9, len(ids) - 8, len(ids) + 5, *range(20, 90)]
    found = corpus.evaluation_blocks(docs, spark.createDataFrame([(s,) for s in starts], "start_token long"), 8)
    got = {r["start_token"]: r["ids"] for r in with_ids(found).collect()}
    assert got == {s: ids[s : s + 9] for s in starts if s + 9 <= len(ids)} and found.count() == len(got)
    assert "NestedLoop" not in plan(found)


def pieces(*numbers):
    raw = [np.array([n, n + 1], "<u2").tobytes() for n in numbers]
    return pa.RecordBatch.from_arrays([pa.array([n // 10 for n in numbers], pa.int64()), pa.array(raw, pa.binary())], ["shard", "raw"])


def writer(folder, **options):
    return shards.ShardWriter({"path": str(folder), "shardtokens": "4", **options}, overwrite=False)


def test_attempts_that_fail_or_repeat_leave_nothing(tmp_path):
    own = writer(tmp_path / "a", record='{"note": 1}')

    def broken():
        yield pieces(0, 1)
        yield pieces(10)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        own.write(broken())
    files, place = own._open()
    assert sizes(f"{place}/{shards.ATTEMPTS}") == {}
    first, again, other = own.write(iter([pieces(0, 1)])), own.write(iter([pieces(0), pieces(1)])), own.write(iter([pieces(10, 11)]))
    assert len(sizes(f"{place}/{shards.ATTEMPTS}")) == 3 and not (tmp_path / "a").exists()
    files.open_output_stream(f"{place}/{shards.ATTEMPTS}/tokens-00000.bin.killed").close()  # an attempt whose executor was lost
    own.commit([again, None, other])
    assert first.shards[0][2] == again.shards[0][2]
    assert sorted(os.listdir(tmp_path)) == ["a"] and sorted(os.listdir(tmp_path / "a")) == ["metadata.json", "tokens-00000.bin", "tokens-00001.bin"]
    assert artifacts.validate(str(tmp_path / "a")) == (8, 16)
    with pytest.raises(OSError):  # one that comes after the commit
        own.write(iter([pieces(0)]))
    assert sorted(os.listdir(tmp_path)) == ["a"]


def test_a_commit_that_fails_leaves_the_old_artifact(tmp_path, monkeypatch):
    old = writer(tmp_path / "a")
    old.commit([old.write(iter([pieces(0)]))])
    new = shards.ShardWriter({"path": str(tmp_path / "a"), "shardtokens": "4"}, overwrite=True)
    message = new.write(iter([pieces(3)]))
    with pytest.raises(ValueError, match="each from one task"):
        new.commit([message, message])
    new.abort([message])
    assert sorted(os.listdir(tmp_path)) == ["a"] and artifacts.validate(str(tmp_path / "a")) == (2, 4)
    late = writer(tmp_path / "a")
    with pytest.raises(FileExistsError):
        late.commit([late.write(iter([pieces(1)]))])
    late.abort([])
    new = shards.ShardWriter({"path": str(tmp_path / "a"), "shardtokens": "4"}, overwrite=True)
    new.commit([new.write(iter([pieces(3, 4)]))])
    assert sorted(os.listdir(tmp_path)) == ["a"] and artifacts.validate(str(tmp_path / "a")) == (4, 8)


def test_jobs_that_fail_leave_nothing(spark, tmp_path):
    raw = F.when(F.col("id") == 37, F.raise_error(F.lit("broken row"))).otherwise(F.unhex(F.lit("01000200")))
    rows = spark.range(40).select((F.col("id") / 10).cast("long").alias("shard"), F.col("id").alias("from_pos"), raw.cast("binary").alias("raw"))
    with pytest.raises(Exception, match="broken row"):
        shards.write_shards(rows, str(tmp_path / "a"), 20)
    assert os.listdir(tmp_path) == []
    shards.write_shards(rows.filter("id < 30"), f"file://{tmp_path}/a", 20, note="by URI")
    assert sorted(os.listdir(tmp_path)) == ["a"] and artifacts.validate(f"file://{tmp_path}/a", check_digests=True, spark=spark) == (60, 120)


def test_block_filters_open_their_shards_alone(spark, tmp_path, monkeypatch):
    ids = np.arange(1000).astype("<u2")
    stream = spark.createDataFrame([(0, 1000, bytearray(ids.tobytes()))], "start_pos long, n_tokens long, raw binary")
    artifacts.publish(stream, str(tmp_path), "a", 100)
    options = {"path": str(tmp_path / "a"), "length": "10", "blockspertask": "16"}

    def opened(*filters):
        reader = TokenBlockReader(options)
        left = list(reader.pushFilters(list(filters)))
        own, names = store(str(tmp_path))[0], []

        class Counting:
            def open_input_file(self, name):
                names.append(os.path.basename(name))
                return own.open_input_file(name)

        monkeypatch.setattr("granary.sources.tokens.store", lambda path: (Counting(), path))
        rows = [n for part in reader.partitions() for batch in reader.read(part) for n in batch.column("block_id").to_pylist()]
        return left, rows, sorted(set(names))

    block = ("block_id",)
    assert opened(GreaterThanOrEqual(block, 31), LessThan(block, 34)) == ([], [31, 32, 33], ["tokens-00003.bin"])
    assert opened(EqualTo(block, 59)) == ([], [59], ["tokens-00005.bin", "tokens-00006.bin"])
    assert opened(GreaterThan(block, 97), LessThanOrEqual(block, 1 << 40))[1] == [98]
    assert opened(EqualTo(block, 5), EqualTo(block, 6)) == ([], [], [])
    kept = In(block, (1, 2))
    assert opened(kept)[0] == [kept] and len(opened(kept)[1]) == 99
    found = read_blocks(spark, str(tmp_path / "a"), 10).filter("block_id >= 31 and block_id < 34 and block_id <> 32")
    assert [(r["block_id"], r["inputs"][0], r["targets"][-1]) for r in found.orderBy("block_id").collect()] == [(31, 310, 320), (33, 330, 340)]


def test_digests_of_a_file_over_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as file:
        file.seek((9 << 28) - 1)
        file.write(b"x")
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "other.txt").write_bytes(b"")
    found = {r["file"]: r for r in shards.file_digests(spark, str(tmp_path), "*.bin").collect()}
    assert found["small.bin"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and set(found) == {"big.bin", "small.bin"}
    assert found["big.bin"]["bytes"] == 9 << 28
    assert shards.file_digests(spark, str(tmp_path), "*.none").count() == 0


def test_small_files_share_a_digest_task(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i:03d}.bin").write_bytes(bytes([i % 256]) * i)
    (tmp_path / "100_large.bin").write_bytes(b"x" * (2 << 20))
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}

    def parts():
        reader = shards.DigestReader({"path": str(tmp_path), "pattern": "*.bin"})
        found = reader.partitions()
        assert {name: (n, sha) for part in found for name, n, sha in reader.read(part)} == want
        return [part.names for part in found]

    assert parts() == [sorted(want)]
    monkeypatch.setattr(shards, "TASK_BYTES", 1 << 20)
    found = parts()
    assert [name for part in found for name in part] == sorted(want) and ["100_large.bin"] in found and 15 < len(found) < 40


def test_a_block_task_gets_its_own_shards_alone(spark, tmp_path, monkeypatch):
    ids = np.arange(1000).astype("<u2")
    stream = spark.createDataFrame([(0, 1000, bytearray(ids.tobytes()))], "start_pos long, n_tokens long, raw binary")
    artifacts.publish(stream, str(tmp_path), "a", 7)
    sample = {"sequence_length": 10, "block_count": 3, "blocks": [{"start_token": at} for at in (500, 3, 989)]}
    artifacts.publish(stream, str(tmp_path), "b", 7, fixed_evaluation_sample=sample)

    def read(name):
        reader = TokenBlockReader({"path": str(tmp_path / name), "length": "10", "blockspertask": "1"})
        parts = reader.partitions()
        sent = pickle.loads(pickle.dumps(reader))
        rows = [(r["block_id"], r["inputs"][0], r["targets"][-1]) for part in parts for batch in sent.read(pickle.loads(pickle.dumps(part))) for r in batch.to_pylist()]
        return rows, len(parts), len(pickle.dumps(reader)), max(len(part.part.files) for part in parts)

    whole, of_sample = [(i, 10 * i, 10 * i + 10) for i in range(99)], [(0, 500, 510), (1, 3, 13), (2, 989, 999)]
    assert read("a")[:2] == (whole, 1) and read("b")[:2] == (of_sample, 1)
    monkeypatch.setattr("granary.sources.tokens.TASK_IDS", 1)
    for name, want in (("a", whole), ("b", of_sample)):
        rows, tasks, sent, files = read(name)
        assert rows == want and tasks == len(want) and sent < 1000 and files <= 3
