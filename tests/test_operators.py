"""Operators on small fixtures that the driver's tables don't cover."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import numeric
from granary.functions.text import byte_ids, is_blank, strip, word_count
from granary.functions.tokenizer import with_ids
from granary.operators import artifacts, batches, corpus, metrics
from granary.plans import catalog
from granary.sources import config, logs, settings
from granary.sources.tokens import Artifact, evaluation_steps, read_blocks, training_blocks

ODD = ["", "  ", None, " x ", "\x1cx\x85", "​x", "a b c", "\n\t", "é ñ", " 　 ", "x"]


def test_text_follows_python(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    got = rows.select("i", strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b"), word_count(F.col("t")).alias("w"), byte_ids(F.col("t")).alias("ids")).collect()
    for r in got:
        t = ODD[r["i"]]
        assert r["b"] == (t is None or not t.strip())
        if t is not None:
            assert r["s"] == t.strip() and r["w"] == len(t.split()) and r["ids"] == [7 + x for x in t.encode()]


def plain_stream(texts):
    return [x for t in texts if t and t.strip() for x in (1, *(7 + b for b in t.strip().encode()), 2)]


def stream_of(spark, texts, parts=3):
    return corpus.token_stream(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts))


@pytest.mark.parametrize("length", [1, 3, 8])
def test_blocks_shards_and_prefixes_are_the_plain_ones(spark, length):
    texts = [*ODD, "abcdefghijklmnop" * 3, "z"]
    ids = plain_stream(texts)
    stream = stream_of(spark, texts).cache()
    got = {r["block_id"]: r["ids"] for r in with_ids(corpus.blocks(stream, length)).collect()}
    assert got == {b: ids[b * length : b * length + length + 1] for b in range((len(ids) - 1) // length)}
    assert {r["block_id"]: r["ids"] for r in with_ids(corpus.blocks(stream.repartition(5), length)).collect()} == got
    assert {r["shard"]: r["ids"] for r in with_ids(corpus.joined(corpus.shard_pieces(stream, 7), "shard")).collect()} == {s: ids[s * 7 : s * 7 + 7] for s in range(-(-len(ids) // 7))}
    for target in (1, 5, 21, len(ids)):
        assert [x for r in with_ids(corpus.prefix(stream, target)).orderBy("start_pos").collect() for x in r["ids"]] == ids[:target]
    stream.unpersist()


def test_empty_corpus(spark):
    stream = stream_of(spark, ["", None])
    assert stream.count() == 0 and corpus.blocks(stream, 4).count() == 0
    stats = corpus.corpus_stats(spark.createDataFrame([], "doc_id long, text string"))
    assert stats.first().asDict() == {"docs": 0, "chars": 0, "words": 0, "tokens": 0}
    assert corpus.token_ratios(stats).first()["tokens_per_word"] is None


@pytest.fixture
def artifact(spark, tmp_path):
    """Ids 0 to 80 in shards of 7."""
    raw = lambda lo, hi: bytearray(np.arange(lo, hi).astype("<u2").tobytes())
    stream = spark.createDataFrame([(0, 40, raw(0, 40)), (40, 41, raw(40, 81))], "start_pos long, n_tokens long, raw binary")
    artifacts.publish(stream, str(tmp_path), "a", 7, tokenizer={"sha256": "t", "vocab_size": 100})
    return tmp_path / "a"


def test_artifact_round_trip(spark, artifact):
    assert artifacts.validate(str(artifact), check_digests=True, spark=spark) == (81, 162)
    record = json.loads((artifact / "metadata.json").read_text())
    assert [s["tokens"] for s in record["shards"]] == [7] * 11 + [4]
    assert record["shards"][1]["sha256"] == hashlib.sha256(np.arange(7, 14).astype("<u2").tobytes()).hexdigest()
    rows = read_blocks(spark, str(artifact), 8, blocks_per_task=3).orderBy("block_id").collect()
    assert len(rows) == 10 and rows[1]["inputs"] == list(range(8, 16)) and rows[1]["targets"] == list(range(9, 17))
    assert read_blocks(spark, str(artifact), 8, start_block=7).count() == 3
    own = Artifact.open(str(artifact), 8)
    assert own.block(-1).tolist() == own.block(9).tolist()
    with pytest.raises(IndexError):
        own.block(10)
    with pytest.raises(ValueError, match="too small"):
        training_blocks(spark, str(artifact), 8, 6, 2)


def test_artifact_faults(spark, artifact, tmp_path):
    with pytest.raises(FileExistsError):
        artifacts.publish(stream_of(spark, ["ab"]), str(tmp_path), "a", 7)
    with pytest.raises(ValueError):
        artifacts.publish(stream_of(spark, ["ab"]), str(tmp_path), "../b", 7)
    (artifact / "tokens-99999.bin").write_bytes(b"")
    with pytest.raises(ValueError, match="inventory"):
        artifacts.validate(str(artifact))
    (artifact / "tokens-99999.bin").unlink()
    (artifact / "tokens-00000.bin").write_bytes(b"bad")
    with pytest.raises(ValueError, match="size"):
        artifacts.validate(str(artifact))
    with pytest.raises(ValueError, match="bytes"):
        Artifact.open(str(artifact), 8)
    with pytest.raises(ValueError):
        artifacts.uint16_bytes([65536])


def test_fixed_evaluation_sample(artifact):
    path = artifact / "metadata.json"
    record = json.loads(path.read_text())
    record["fixed_evaluation_sample"] = {"sequence_length": 8, "block_count": 5, "blocks": [{"start_token": s} for s in (0, 11, 25, 38, 50)]}
    path.write_text(json.dumps(record))
    own = Artifact.open(str(artifact), 8)
    assert [own.block(i)[0] for i in range(len(own))] == [0, 11, 25, 38, 50]
    with pytest.raises(ValueError):
        Artifact.open(str(artifact), 4)
    with pytest.raises(ValueError, match="steps"):
        evaluation_steps(own, 3, 1)
    assert evaluation_steps(own, 3, 9) == 2


def test_identity_is_of_the_data(artifact):
    record = json.loads((artifact / "metadata.json").read_text())
    same = artifacts.identity({**record, "dataset": {"name": "elsewhere"}})
    assert same == artifacts.identity(record) != artifacts.identity({**record, "token_count": 80})
    with pytest.raises(ValueError):
        artifacts.identity({**record, "tokenizer": {}})
    artifacts.compatible(record, record, 100)
    with pytest.raises(ValueError, match="vocabulary"):
        artifacts.compatible(record, record, 99)


def test_nested_prefixes(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(12)], "doc_id long, text string")
    got = artifacts.build_artifacts(docs, str(tmp_path), {"s": 20, "m": 100, "l": 200}, 32)
    raw = {n: b"".join((tmp_path / n / s["file"]).read_bytes() for s in got[n]["shards"]) for n in got}
    assert raw["l"].startswith(raw["m"]) and raw["m"].startswith(raw["s"]) and got["s"]["is_prefix_of"] == "m" and got["l"]["is_prefix_of"] is None
    with pytest.raises(ValueError, match="wanted"):
        artifacts.build_artifacts(docs, str(tmp_path / "b"), {"x": 10**6}, 32)


def test_epochs(spark):
    blocks = spark.range(25).withColumnRenamed("id", "block_id")
    order = lambda e, s=0: [(r["batch_id"], r["block_id"]) for r in batches.train_batches(blocks, 2, 42, e, s).orderBy("batch_id", "slot").collect()]
    first = order(0)
    assert len(first) == 24 and len({b for _, b in first}) == 24 and order(0) == first != order(1)
    assert order(0, 1) == first[2:]
    with pytest.raises(ValueError):
        order(0, 13)
    assert batches.horizon(16, 2, 2, 3) == (4, 12) and batches.horizon(16, 2, 2, 3, 5) == (4, 5) and batches.horizon(18, 2, 2, 2) == (4, 8)
    sizes = batches.validation_batches(spark.range(5).withColumnRenamed("id", "block_id"), 2).groupBy("batch_id").count().orderBy("batch_id")
    assert [r["count"] for r in sizes.collect()] == [2, 2, 1]


def test_schedules(spark):
    steps = spark.range(8)
    got = lambda *a: [r[0] for r in steps.orderBy("id").select(numeric.lr_multiplier(F.col("id"), *a)).collect()]
    assert got(8, 2, "cosine", 0.1) == pytest.approx([0.5, 1, *(0.1 + 0.9 * (1 + math.cos(math.pi * i / 5)) / 2 for i in range(6))])
    assert got(8, 2, "wsd", 0.1, 0.5) == pytest.approx([0.5, 1, 1, 1, 1, 1, 0.55, 0.1])
    with pytest.raises(ValueError):
        numeric.lr_multiplier(F.lit(1), 2, 2, "cosine", 0.1)


def test_kernels_on_ties(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 1, 3, 3, 0)])
    row = spark.range(1).select(numeric.top_k(v, 2).alias("k"), numeric.top_k(v, 99).alias("all"), numeric.softmax(numeric.masked(v, [0]), 1.0).alias("p"), numeric.cross_entropy(v, F.lit(1)).alias("ce")).first()
    assert row["k"] == [3, None, 3, 3, None] and row["all"] == [3, 1, 3, 3, 0]
    assert row["p"][0] == 0 and sum(row["p"]) == pytest.approx(1)
    assert row["ce"] == pytest.approx(math.log(sum(math.exp(x) for x in (3, 1, 3, 3, 0))) - 1)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    runs = {"one": rng.normal(size=1), "short": rng.normal(size=50), "long": rng.normal(size=400)}
    rows = [(r, i + 1, float(x)) for r, v in runs.items() for i, x in enumerate(v)]
    series = spark.createDataFrame(rows, "run string, step long, value double")
    got = metrics.rolling_median(series).toPandas()
    for run, v in runs.items():
        want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, (100, 100), mode="edge"), 201), axis=1)
        np.testing.assert_allclose(got[got.run == run].sort_values("step")["median"], want)
    summary = {r["run"]: r for r in metrics.spike_summary(series, series, series, after_step=10, limit=2.0).collect()}
    assert summary["one"]["clipped_percent"] is None and summary["one"]["largest_increase"] is None and summary["long"]["unaligned"] == 0
    at = [i for i, x in enumerate(runs["long"]) if i + 1 > 10 and x > 2]
    resid = runs["long"] - got[got.run == "long"].sort_values("step")["median"].to_numpy()
    after = [resid[i + 1 : i + 21].mean() for i in at if i + 21 <= 400]
    assert summary["long"]["clipped_steps"] == len(at) and summary["long"]["next_loss_residual_mean"] == pytest.approx(np.mean(after))


def test_throughput_windows(spark):
    log = spark.createDataFrame([("r", s, s * 10, 1.0) for s in range(1, 9)], "run string, step long, tokens_seen long, seconds double")
    assert [r["step"] for r in metrics.throughput_windows(log, 3, 6, 4).orderBy("step").collect()] == [3, 4, 6, 8]
    assert [r["step"] for r in metrics.throughput_windows(log.filter("step <= 5"), 3, 6, 4).orderBy("step").collect()] == [3, 4, 5]


def test_throughput_windows_of_whole_runs(spark, tmp_path):
    lengths = {"short": 5, "edge": 40, "long": 131}
    events = [(i, run, 1.0) for i, run in enumerate(run for run, n in lengths.items() for _ in range(n))]
    spark.createDataFrame(events, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    expected = []
    for run, last in lengths.items():
        since, seconds = 0, 0.0
        for step in range(1, last + 1):
            seconds += 1 + step % 3
            if step - since >= 3 or step % 6 == 0 or step == last or (step % 4 == 0 and step < last):
                expected.append((run, step, (step - since) * 16, seconds, round((step - since) * 16 / seconds, 6)))
                since, seconds = step, 0.0
    got = catalog.QUERIES["throughput_windows"](spark, str(tmp_path)).select("run", "step", "tokens", "seconds", "tokens_per_second").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_registry(spark, tmp_path):
    row = lambda model, conf: ("e", "v", metrics.format_loss(3.25), "3.5", "s", model, conf)
    table = lambda *rows: spark.createDataFrame(list(rows), metrics.REGISTRY)
    path = str(tmp_path / "runs.csv")
    assert logs.append_registry(spark, path, table(row("m", 'a = 1\nb = "x,y"'))) == 1
    assert logs.append_registry(spark, path, table(row("m", 'a = 1\nb = "x,y"'), row("m2", "c = 1"), row("m2", "c = 1"))) == 1
    got = logs.read_registry(spark, path)
    assert {r["config"] for r in got.collect()} == {'a = 1\nb = "x,y"', "c = 1"}
    assert metrics.selected_results(got.limit(1), ["e"]).first()["perplexity"] == pytest.approx(math.exp(3.5))


def test_metric_files_and_listing(spark, tmp_path):
    rows = spark.createDataFrame([("train/loss", 1, 0.0, 2.0)], "tag string, step long, wall_time double, value double")
    rows.toPandas().to_csv(tmp_path / "run_a.csv", index=False)
    assert logs.read_metrics(spark, str(tmp_path)).first()["run"] == "run_a"
    (tmp_path / "c").mkdir()
    for n in (1, 2):
        (tmp_path / "c" / f"step_{n:08d}.pt").write_bytes(b"x")
    (tmp_path / "c" / "other.txt").write_bytes(b"x")
    listed = logs.list_checkpoints(spark, str(tmp_path / "c"))
    kept = metrics.retained(listed, 1, just_written=next(r["path"] for r in listed.collect() if "00001" in r["path"]))
    (tmp_path / "c" / "a").mkdir()
    (tmp_path / "c" / "a" / "step_00000003.pt").write_bytes(b"xyz")
    below = [(r["path"].rpartition("/c/")[2], r["bytes"]) for r in logs.list_checkpoints(spark, str(tmp_path / "c"), recursive=True).collect()]
    assert below == [("a/step_00000003.pt", 3), ("other.txt", 1), ("step_00000001.pt", 1), ("step_00000002.pt", 1)]
    paths = [r["path"] for r in listed.collect()]
    assert len(paths) == 3 and paths == sorted(paths)
    assert {(r["path"][-11:], r["keep"]) for r in kept.collect()} == {("00000001.pt"[-11:], True), ("00000002.pt"[-11:], False)}


def test_metrics_come_back_as_written(spark, tmp_path, monkeypatch):
    steps = [(1, 0.1), (9, None), (9, None), (None, -1e300)]
    rows = [(value, step, 1 / 3, tag, run, "more") for run in ("007", "a=b/c %41+d", None) for tag in (' "x", y ', None) for step, value in steps]
    log = spark.createDataFrame(rows, "value double, step long, wall_time double, tag string, run string, run_id string")
    monkeypatch.setattr(logs, "STEPS_PER_FILE", 4)
    logs.write_metrics(log, str(tmp_path / "logs"))
    got = logs.read_metrics(spark, str(tmp_path / "logs"))
    assert got.columns == ["run", "tag", "step", "wall_time", "value"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, log.select(got.columns).collect())))
    assert "PartitionFilters: [isnotnull(run" in got.filter("run = '007'")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="exist"):
        logs.write_metrics(log, str(tmp_path / "logs"))
    (tmp_path / "none").mkdir()
    assert logs.read_metrics(spark, str(tmp_path / "none")).count() == 0


def test_registry_keeps_texts_and_the_order_of_columns(spark, tmp_path):
    config = '\ta = "x, y"\n\n[m]\nb = 1\n '
    rows = spark.createDataFrame([(config, "m", "e"), (config, "m", "e"), (None, "m", "f")], "config string, model_path string, experiment_name string")
    for name in ("train_script", "validation_loss", "train_loss", "dataset_variant"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    path = str(tmp_path / "runs.csv")
    assert logs.append_registry(spark, path, rows.withColumn("more", F.lit(1))) == 2
    assert logs.append_registry(spark, path, rows) == 0
    assert {(r["model_path"], r["config"], r["experiment_name"]) for r in logs.read_registry(spark, path).collect()} == {("m", config, "e"), ("m", None, "f")}
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        logs.append_registry(spark, path, rows.drop("config"))


def test_config(tmp_path):
    (tmp_path / "base.toml").write_text('a = 1\nlist = [1, 2]\n[m]\nx = 1\ny = "q"\n')
    (tmp_path / "top.toml").write_text('extends = ["base.toml"]\nlist = [3]\n[m]\nx = 2\n')
    got = config.load(tmp_path / "top.toml")
    assert got == {"a": 1, "list": [3], "m": {"x": 2, "y": "q"}}
    assert config.parse(config.dump(got)) == got == config.parse(config.compact(got))
    (tmp_path / "loop.toml").write_text('extends = ["loop.toml"]\n')
    with pytest.raises(ValueError, match="circular"):
        config.load(tmp_path / "loop.toml")
    changes = config.overrides(['m.x=5; m.y="a;b"', "list=[1, 2];a=plain/path; a=7"])
    assert changes == {"m.x": 5, "m.y": "a;b", "list": [1, 2], "a": 7}
    assert config.apply(got, changes)["m"] == {"x": 5, "y": "a;b"}
    for bad in ("a", "=1", "a=", "a=[1", "a=1]"):
        with pytest.raises(ValueError):
            config.overrides([bad])
    with pytest.raises(ValueError):
        config.apply(got, {"m.z": 1})
    with pytest.raises(ValueError):
        config.dump({"a": None})
    assert config.unknown({"m": {"z": 1}, "q": 1}, got) == ["m.z", "q"]
    config.save(got, tmp_path / "out.toml")
    assert config.load(tmp_path / "out.toml") == got


def test_streaming_equals_batch(spark, tmp_path):
    from granary.streaming.ingest import DOCUMENTS, ingest

    rows = [(i, f"text {i}", "en", "s", 6) for i in range(20)] + [(20, " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.filter("doc_id < 9").repartition(3).write.parquet(str(tmp_path / "in"))
    call = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cursor"))
    call()
    docs.filter("doc_id >= 9").write.mode("append").parquet(str(tmp_path / "in"))
    call()
    call()
    got = {r["doc_id"]: r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["doc_id"]: r["ids"] for r in corpus.framed_bytes(docs).collect()} and len(got) == 20


def test_optimizer_groups(spark):
    rows = spark.createDataFrame([("embeddings.weight", 2), ("b.attn.c_attn.weight", 2), ("norm.weight", 1), ("b.conv.weight", 3), ("b.bias", 1)], "name string, dims int")
    muon = {r["name"]: r["g"] for r in rows.select("name", metrics.optimizer_group(F.col("name"), F.col("dims"), True).alias("g")).collect()}
    assert muon == {"embeddings.weight": "no_decay", "b.attn.c_attn.weight": "muon", "norm.weight": "norm", "b.conv.weight": "decay", "b.bias": "no_decay"}


def test_artifacts_as_checked_rows(spark, artifact, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "metadata.json").write_text("{")
    record = json.loads((artifact / "metadata.json").read_text())
    (tmp_path / "c").mkdir()
    record["shards"][0] |= {"file": "../x", "bytes": "no"}
    (tmp_path / "c" / "metadata.json").write_text(json.dumps(record))
    rows = artifacts.artifact_checks(spark, str(tmp_path), ["a", "b", "c", "none"]).collect()
    bad = {(r["artifact"], r["check"]) for r in rows if not r["ok"]}
    assert bad == {("b", "record"), ("none", "record"), ("c", "names"), ("c", "byte_counts"), ("c", "inventory"), ("c", "total")}
    assert all(r["ok"] == (r["detail"] == "") for r in rows)
    digests = {r["file"]: r["sha256"] for r in artifacts.file_digests(spark, str(artifact), "tokens-*.bin").collect()}
    assert digests["tokens-00001.bin"] == hashlib.sha256(np.arange(7, 14).astype("<u2").tobytes()).hexdigest() and len(digests) == 12
    plain = json.loads((artifact / "metadata.json").read_text())
    shards = spark.createDataFrame([("a", i, s["tokens"], s["sha256"]) for i, s in enumerate(plain["shards"])], "artifact string, shard long, tokens long, sha256 string")
    about = spark.createDataFrame([("a", "t", 100)], "artifact string, tokenizer_sha256 string, vocab_size int")
    stored = {k: v for k, v in plain["storage"].items() if k != "shard_token_limit"}
    assert artifacts.identities(shards, about).first()["identity"] == artifacts.identity({**plain, "storage": stored})


def test_registry_knows_a_configuration_in_any_form(spark):
    row = lambda conf: ("e", "v", "1", "2", "s", "m", conf)
    table = lambda *rows: spark.createDataFrame(list(rows), metrics.REGISTRY)
    new = lambda there, *confs: metrics.new_registry_rows(table(row(there)), table(*map(row, confs))).count()
    assert new('name = "a b"', 'name = "ab"') == 1
    assert new('name = "x"\n\n[training]\nepochs = 3\n', 'config = {name = "x", training = {epochs = 3}}') == 0
    assert new("a = 1", "config = {a = 2}", "a = 2", "not toml", "not toml") == 2


def test_retention_is_per_folder(spark):
    files = spark.createDataFrame([(f"{run}/step_{i:08d}.pt", i) for run in "ab" for i in range(5)] + [("a/other.pt", 9)], "path string, mtime_ns long")
    kept = lambda **o: sorted(r["path"] for r in metrics.retained(files, 2, **o).filter("keep").collect())
    assert kept() == ["a/step_00000003.pt", "a/step_00000004.pt", "b/step_00000003.pt", "b/step_00000004.pt"]
    assert kept(just_written="a/step_00000001.pt") == ["a/step_00000001.pt", "a/step_00000004.pt", "b/step_00000003.pt", "b/step_00000004.pt"]


def test_a_loss_is_one_number(spark):
    rows = spark.createDataFrame([("r", 1.0), ("r", 3.0)], "run string, value double")
    assert metrics.reduced(rows, lambda g: g["value"].mean(), "run").first()["loss"] == 2.0
    with pytest.raises(Exception, match="one number"):
        metrics.reduced(rows, lambda g: [1.0], "run").collect()


@pytest.mark.parametrize("runs", [1, 2, 7, 40])
def test_offsets_are_alike_over_any_number_of_runs(spark, runs):
    rows = spark.createDataFrame([(i * 7 % 101, i % 5 + 1) for i in range(101)], "doc_id long, n long")
    got = {r["doc_id"]: r["before"] for r in corpus.running_total(rows, "doc_id", "n", "before", runs).collect()}
    sizes, total = {i * 7 % 101: i % 5 + 1 for i in range(101)}, 0
    for i in range(101):
        assert got[i] == total
        total += sizes[i]
    stream = corpus.token_stream(spark.createDataFrame([(i, "ab" * (i % 4)) for i in range(60)], "doc_id long, text string"), runs=runs)
    blocks = {r["block_id"]: r["ids"] for r in with_ids(corpus.blocks(stream, 5)).collect()}
    ids = plain_stream(["ab" * (i % 4) for i in range(60)])
    assert blocks == {b: ids[b * 5 : b * 5 + 6] for b in range((len(ids) - 1) // 5)}
