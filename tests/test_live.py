"""Chunks of runs, exact quantiles, live windows and ingest up to a token target, against plain Python and the batch."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import corpus, metrics, windows
from granary.operators.quantiles import exact_quantiles
from granary.streaming import ingest


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_rolling_median_is_the_same_for_any_chunk(spark, chunk):
    r = random.Random(chunk)
    series = {"a": [r.gauss(0, 1) for _ in range(83)], "b": [5.0], "c": [r.choice([1.0, 2.0]) for _ in range(7)]}
    rows = [(run, 10 * i + 3, v) for run, values in series.items() for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "run string, step long, value double").repartition(5)
    found = metrics.rolling_median(table, 4, chunk=chunk, runs=3)
    got = {(x["run"], x["step"]): x["median"] for x in found.collect()}
    for run, values in series.items():
        padded = [values[0]] * 4 + values + [values[-1]] * 4
        for i in range(len(values)):
            assert got[run, 10 * i + 3] == pytest.approx(np.median(padded[i : i + 9]))
    assert len(got) == len(rows)
    means = {(x["run"], x["step"]): x["m"] for x in metrics.following_means(found, "value", 3, "m", chunk=chunk).collect()}
    for run, values in series.items():
        for i in range(len(values)):
            ahead = values[i + 1 : i + 4]
            assert means[run, 10 * i + 3] == (pytest.approx(sum(ahead) / 3) if len(ahead) == 3 else None)


@pytest.mark.parametrize("few", [6, 100_000])
def test_quantiles_are_exact(spark, few):
    r = random.Random(3)
    groups = {
        "same": [2.5] * 300, "wide": [r.uniform(-1, 1) * 10 ** r.randint(-20, 20) for _ in range(500)], "one": [7.0], "ends": [-math.inf, math.inf, 1.0, -1.7e308, 1.7e308],
        "twice": [float(r.randint(0, 3)) for _ in range(400)], "near": [1 + i * 2**-52 for i in range(200)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("wide", None), ("one", math.nan), ("none", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "most": 1.0}
    found = {x["k"]: x for x in exact_quantiles(table, ["k"], "v", wanted, few=few).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        values = sorted(max(-1.7976931348623157e308, min(1.7976931348623157e308, v)) for v in values)
        for name, q in wanted.items():
            at = (len(values) - 1) * q
            low, high = math.floor(at), math.ceil(at)
            assert found[k][name] == pytest.approx(values[low] * (1 - (at - low)) + values[high] * (at - low), rel=1e-12)


def log_of(lengths, skip=()):
    return [(run, s, 16 * s, 1.0 + s % 3) for run, n in lengths.items() for s in range(1, n + 1) if (run, s) not in skip]


def plain_windows(log, interval, validate, checkpoint):
    out, runs = [], {}
    for row in log:
        runs.setdefault(row[0], []).append(row)
    for run, rows in runs.items():
        since, tokens, seconds = 0, 0, 0.0
        for _, step, seen, spent in sorted(rows):
            seconds += spent
            if step - since >= interval or step % validate == 0 or step == max(r[1] for r in rows) or step % checkpoint == 0:
                out.append((run, step, seen - tokens, seconds))
                since, tokens, seconds = step, seen, 0.0
    return sorted(out)


LOG = "run string, step long, tokens_seen long, seconds double"


@pytest.mark.parametrize("stretches,runs", [(1, 1), (3, 4), (1024, 2)])
def test_windows_of_many_stretches(spark, stretches, runs):
    log = log_of({"a": 97, "b": 1, "c": 40}, skip={("a", 24), ("a", 25), ("a", 26), ("c", 1)})
    found = windows.throughput_windows(spark.createDataFrame(log, LOG), 5, 12, 20, runs=runs, stretches=stretches)
    assert sorted(tuple(r)[:4] for r in found.collect()) == plain_windows(log, 5, 12, 20)


def test_live_windows_are_the_batch_ones_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = log_of({"a": 61, "b": 9})
    parts = [log[:20], log[15:50], log[50:]]  # five steps are told twice
    put = lambda i: spark.createDataFrame(parts[i], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    want = plain_windows(log, 5, 12, 20)

    def run(until):
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        live = windows.live_throughput_windows(stream, 5, 12, 20, idle=4.0)
        query = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        begin = time.time()
        while not until() and time.time() - begin < 120 and query.isActive:
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None

    def got():
        if not (tmp_path / "out" / "_spark_metadata").exists():
            return []
        return sorted(tuple(r)[:4] for r in spark.read.schema("run string, step long, tokens long, seconds double, tokens_per_second double").parquet(str(tmp_path / "out")).collect())

    put(0)
    run(lambda: len(got()) >= 4)
    first = got()
    put(1)
    put(2)
    run(lambda: len(got()) >= len(want))
    assert set(first) <= set(got()) and [r for r in got() if r[0] == "b"] == [r for r in want if r[0] == "b"]
    ends = {r[1] for r in want if r[0] == "a"}
    # the timer may have closed the first part's open window while the query was down; all else is the batch's
    assert {r[1] for r in got() if r[0] == "a"} >= {s for s in ends if s > 24} and sum(r[2] for r in got() if r[0] == "a") == 61 * 16


def test_ingest_stops_at_the_target_and_goes_on(spark, tmp_path):
    folder = tmp_path / "in"
    texts = [f"text {i} " + "x" * (i % 13) if i % 7 else " " for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], ingest.DOCUMENTS)
    folder.mkdir()
    for n in range(6):
        docs.filter(f"doc_id >= {10 * n} and doc_id < {10 * n + 10}").toPandas().to_parquet(folder / f"part-{n}.parquet")
        os.utime(folder / f"part-{n}.parquet", (1_700_000_000 + 10 * n,) * 2)
    whole = corpus.token_stream(docs.select("doc_id", "text"))
    total = whole.agg(F.sum("n_tokens")).first()[0]
    good = (folder / "part-4.parquet").read_bytes()
    (folder / "part-4.parquet").write_bytes(b"not a table")
    os.utime(folder / "part-4.parquet", (1_700_000_040,) * 2)
    call = lambda target: ingest.ingest_prefix(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "c"), target)
    rows = lambda df: sorted((r["start_pos"], r["doc_id"], r["n_tokens"], bytes(r["raw"])) for r in df.collect())
    third = corpus.token_offsets(docs).filter("doc_id < 30").agg(F.sum("n_tokens")).first()[0]
    for target in (5, third // 2, third // 2 + 3, third, third + 40):
        cursor = call(target)
        assert cursor["complete"] and cursor["tokens"] == target
        assert rows(ingest.ingested(spark, str(tmp_path / "out"))) == rows(corpus.prefix(whole, target))
    last = corpus.prefix(whole, third + 40).orderBy(F.desc("start_pos")).first()
    assert cursor["last_doc"] == last["doc_id"] and cursor["last_doc_tokens"] == last["n_tokens"]
    (folder / "part-4.parquet").write_bytes(good)  # never opened so far
    os.utime(folder / "part-4.parquet", (1_700_000_040,) * 2)
    cursor = call(total + 1)
    assert not cursor["complete"] and cursor["tokens"] == total
    assert rows(ingest.ingested(spark, str(tmp_path / "out"))) == rows(whole)
    with pytest.raises(ValueError):
        call(0)


def test_streams_of_string_ids(spark, tmp_path):
    schema = "doc_id string, text string"
    docs = spark.createDataFrame([(f"d{i:02d}/ä", "text " * i) for i in range(20)] + [("e", None), ("f", " ")], schema)
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = lambda df: sorted((r["start_pos"], r["doc_id"], r["n_tokens"], bytes(r["raw"])) for r in df.collect())
    cursor = ingest.ingest_prefix(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), 150, schema=schema)
    assert cursor["complete"] and cursor["tokens"] == 150
    assert rows(ingest.ingested(spark, str(tmp_path / "out"))) == rows(corpus.prefix(corpus.token_stream(docs), 150))
    assert cursor["last_doc"] == rows(ingest.ingested(spark, str(tmp_path / "out")))[-1][1]
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "framed"), str(tmp_path / "d"), schema=schema)
    framed = spark.read.parquet(str(tmp_path / "framed"))
    assert {r["doc_id"] for r in framed.collect()} == {f"d{i:02d}/ä" for i in range(1, 20)}


def _event(step, wall, *values):
    """An event's bytes: (tag, value, form), form 0 for a plain value, 1 and 2 for a float or double tensor."""
    import struct

    def varint(n):
        out = bytearray()
        n &= (1 << 64) - 1
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def part(number, raw):
        return varint(8 * number + 2) + varint(len(raw)) + raw

    summary = b""
    for tag, value, form in values:
        number = struct.pack("<f", value) if form < 2 else struct.pack("<d", value)
        tensor = b"\x08" + bytes([form]) + part(4 if form == 1 else 6, number)
        summary += part(1, part(1, tag.encode()) + (b"\x15" + number if form == 0 else part(8, tensor)))
    return b"\x09" + struct.pack("<d", wall) + b"\x10" + varint(step) + part(5, summary)


def _framed(data, broken=""):
    import struct

    from granary.sources.eventlogs import masked_crc

    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head) ^ (broken == "length")) + data + struct.pack("<I", masked_crc(data) ^ (broken == "data"))


def test_event_files(spark, tmp_path):
    from granary.sources.eventlogs import fields, masked_crc, read_events

    assert masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF  # the checksum's published check value
    with pytest.raises(ValueError):
        list(fields(b"\x0b"))
    files = {
        ("a", "events.out.tfevents.1"): [_framed(_event(1, 2.5, ("loss", 0.5, 0), ("lr", 0.25, 1))), _framed(b""), _framed(_event(-3, 3.0, ("größe", 1e-300, 2))), _framed(_event(4, 1.0, ("x", 1.0, 0)))[:-3]],
        ("b", "events.out.tfevents.1"): [_framed(_event(1, 0.0, ("loss", 1.0, 0)), "data"), _framed(_event(2, 0.0, ("loss", 2.0, 0))), _framed(_event(3, 0.0), "length"), _framed(_event(4, 0.0, ("loss", 4.0, 0)))],
        ("b", "notes.txt"): [b"no events"],
        ("c", "events.out.tfevents.2"): [_framed(b"\x2a\x7f"), b"\x01"],
        ("d", "events.out.tfevents.3"): [],
    }
    for (run, name), parts in files.items():
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_bytes(b"".join(parts))
    found = read_events(spark, str(tmp_path)).collect()
    good = sorted((r["run"], r["tag"], r["step"], r["wall_time"], r["value"]) for r in found if not r["fault"])
    assert good == [("a", "größe", -3, 3.0, 1e-300), ("a", "loss", 1, 2.5, 0.5), ("a", "lr", 1, 2.5, 0.25), ("b", "loss", 2, 0.0, 2.0)]
    assert sorted((r["run"], r["fault"]) for r in found if r["fault"]) == [("b", "record 0: checksum"), ("b", "record 2: checksum"), ("c", "record 0: a field over the record's end")]
    (tmp_path / "none").mkdir()
    assert read_events(spark, str(tmp_path / "none")).count() == 0
