"""Settings and the library tokenizer."""

import json
import logging
import os
import warnings

import pytest

from granary.functions.tokenizer import check, decoded, encoded, framed_tokens, token_measures, with_ids
from granary.operators import corpus
from granary.sources import config, settings

from .conftest import SF


def test_defaults_and_checks():
    got = settings.validated({"name": "run"})
    assert got["model"]["embed_dim"] == 512 and got["optimizer"]["muon"]["ns_coefficients"] == [3.4445, -4.775, 2.0315]
    assert settings.validated({"name": "run", "optimizer": {"lr": 1}})["optimizer"]["lr"] == 1.0
    bad = [
        {}, {"name": "../x"}, {"name": "a", "model": {"embed_dim": 0}}, {"name": "a", "model": {"embed_dim": True}}, {"name": "a", "model": {"embed_dim": 513}}, {"name": "a", "model": {"qk_norm": 1}}, {"name": "a", "optimizer": {"kind": "sgd"}},
        {"name": "a", "optimizer": {"lr": float("inf")}}, {"name": "a", "optimizer": {"lr": 0.1, "schedule": {"min_lr": 0.2}}}, {"name": "a", "training": {"max_steps": 10}}, {"name": "a", "model": 3}, {"name": "a", "optimizer": {"muon": {"ns_coefficients": [1.0]}}},
        {"name": "a", "train_dataset": {"path": ""}},
    ]
    for data in bad:
        with pytest.raises(ValueError):
            settings.validated(data)
    with pytest.warns(UserWarning, match="model.other"):
        assert settings.validated({"name": "a", "model": {"other": 1}})["model"]["other"] == 1


def test_old_layouts_move():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = settings.validated({"name": "a", "data": {"train": "x", "validation": "y"}, "validation_dataset": {"path": "z"}, "schedule": {"kind": "wsd", "warmup_steps": 3}, "optimizer": {"schedule": {"warmup_steps": 4}}})
    assert got["train_dataset"]["path"] == "x" and got["validation_dataset"]["path"] == "z"
    assert got["optimizer"]["schedule"]["kind"] == "wsd" and got["optimizer"]["schedule"]["warmup_steps"] == 4


def test_load_with_overrides(tmp_path):
    (tmp_path / "run.toml").write_text('name = "run"\n[training]\nepochs = 2\n')
    got = settings.load(str(tmp_path / "run.toml"), ["training.epochs=3; optimizer.lr=0.01"])
    assert got["training"]["epochs"] == 3 and got["optimizer"]["lr"] == 0.01
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "run.toml"), ["training.epoch=3"])


def test_parameter_count():
    model = settings.defaults()["model"] | {"vocab_size": 10, "embed_dim": 4, "ffn_dim": 6, "n_blocks": 2, "attn_heads": 1}
    assert settings.parameter_count(model) == 40 + 2 * (64 + 72 + 16 + 8) + 4
    assert settings.parameter_count(model | {"attn_bias": True, "qk_norm": True}) == 412
    assert settings.parameter_count(model | {"canon_layers": True, "split_qkv_projections": True, "attn_bias": True}) == 652


def test_find_checkpoint(tmp_path):
    with pytest.raises(NotADirectoryError):
        settings.find_checkpoint(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        settings.find_checkpoint(tmp_path)
    (tmp_path / "old.pt").write_bytes(b"")
    assert settings.find_checkpoint(tmp_path).name == "old.pt"
    (tmp_path / "older.pt").write_bytes(b"")
    with pytest.raises(ValueError):
        settings.find_checkpoint(tmp_path)
    for n, at in ((5, 100), (3, 200)):
        (tmp_path / f"step_{n}.pt").write_bytes(b"")
        os.utime(tmp_path / f"step_{n}.pt", (at, at))
    assert settings.find_checkpoint(tmp_path).name == "step_3.pt" and settings.find_checkpoint(tmp_path, "old.pt").name == "old.pt"


def test_library_tokenizer(spark):
    import public_tokenizers
    import sentencepiece

    proto = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    own = sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert check(proto) == 32000
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 20").select("doc_id", "text").union(spark.createDataFrame([(99, " "), (98, None)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    framed = {r["doc_id"]: r["ids"] for r in encoded(docs, proto).collect()}
    assert framed == {i: [1, *own.encode(t.strip()), 2] for i, t in texts.items() if t and t.strip()}
    plain = {r["doc_id"]: r["ids"] for r in encoded(docs, proto, framed=False).collect()}
    assert plain == {i: own.encode(t or "") for i, t in texts.items()}
    assert {r["doc_id"]: r["ids"] for r in with_ids(framed_tokens(docs, proto)).collect()} == framed
    back = {r["doc_id"]: r["text"] for r in decoded(encoded(docs, proto), proto).collect()}
    assert back == {i: own.decode(x) for i, x in framed.items()}
    measured = {r["doc_id"]: tuple(r)[1:] for r in token_measures(docs, proto).collect()}
    assert measured == {i: (len(t or ""), len((t or "").split()), len(plain[i])) for i, t in texts.items()}
    stats = corpus.corpus_stats(docs, proto).first()
    assert (stats["docs"], stats["tokens"]) == (len(texts), sum(map(len, plain.values())))
    ids = [x for i in sorted(framed) for x in framed[i]]
    blocks = {r["block_id"]: r["ids"] for r in with_ids(corpus.blocks(corpus.token_stream(docs, proto), 64)).collect()}
    assert blocks == {b: ids[b * 64 : b * 64 + 65] for b in range((len(ids) - 1) // 64)}
    starts = spark.createDataFrame([(0,), (100,), (len(ids) - 10,)], "start_token long")
    assert {r["start_token"]: r["ids"] for r in with_ids(corpus.evaluation_blocks(docs, starts, 64, proto)).collect()} == {s: ids[s : s + 65] for s in (0, 100)}
    sample = corpus.byte_budget_sample(docs, 3000, with_text=True).collect()
    assert sample and all(r["text"] == texts[r["doc_id"]].strip() and r["n_bytes"] == len(r["text"].encode()) for r in sample)


def test_settings_round_trips(tmp_path):
    own = settings.Settings.from_dict({"name": "run", "optimizer": {"lr": 0.5}})
    assert settings.Settings.from_string(own.to_string()) == own == settings.Settings.from_string(own.to_toml())
    own.save(tmp_path / "run.toml")
    assert settings.Settings.load(tmp_path / "run.toml") == own and own.with_overrides("optimizer.lr=0.25")["optimizer"]["lr"] == 0.25
    own["optimizer"]["lr"] = -1.0
    with pytest.raises(ValueError):
        own.save(tmp_path / "run.toml")
    assert settings.Settings.load(tmp_path / "run.toml")["optimizer"]["lr"] == 0.5


def test_presets_and_their_places(tmp_path, monkeypatch):
    tuned = settings.preset("35m_tuned")
    assert tuned["model"]["n_blocks"] == 11 and tuned["optimizer"]["muon"] == {"lr_multiplier": 1.0, "weight_decay": 0.0375} and tuned["optimizer"]["schedule"]["kind"] == "wsd"
    settings.validated(config.merge(tuned, {"name": "x", "training": {"max_steps": 0}}))
    for bad in ("100m_tuned", "7m", "35m_other"):
        with pytest.raises(ValueError):
            settings.preset(bad)
    (tmp_path / "presets").mkdir()
    (tmp_path / "here").mkdir()
    monkeypatch.chdir(tmp_path / "here")
    (tmp_path / "presets" / "small.toml").write_text("")
    assert config.locate("small", presets=tmp_path / "presets").parent.name == "presets"
    (tmp_path / "here" / "small.toml").write_text("")
    assert config.locate("small", presets=tmp_path / "presets").parent.name == "here"
    (tmp_path / "small.toml").write_text("")
    assert config.locate("small.toml", beside=tmp_path).parent == tmp_path
    with pytest.raises(FileNotFoundError):
        config.locate("none", presets=tmp_path / "presets")


def test_layers_fold(tmp_path):
    assert config.merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 4}, "d": {"e": 5}}) == {"a": {"b": 4, "c": 2}, "d": {"e": 5}}
    assert config.merge({"a": {"b": 1}}, {"a": 2}) == {"a": 2} and config.merge({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}} and config.merge({"a": 1}, {"a": {}}) == {"a": {}}
    for name, text in {"a": "x = 1\ny = 1\nz = 1", "b": 'extends = ["a.toml"]\ny = 2', "c": "y = 3\nz = 3", "top": 'extends = ["b.toml", "c.toml"]\nw = 4'}.items():
        (tmp_path / f"{name}.toml").write_text(text + "\n")
    assert config.load(tmp_path / "top.toml") == {"x": 1, "y": 3, "z": 3, "w": 4}
    assert config.load(tmp_path / "top.toml", ["a.toml"]) == {"x": 1, "y": 1, "z": 1, "w": 4}
    assert config.unknown({"l": [{"p": 1}, {"q": 2}], "m": {"x": {"y": 1}}}, {"l": [{"p": 0}], "m": {"x": 1}}) == ["l[1].q"]


def test_logging_sinks(tmp_path):
    own = settings.validated({"name": "a", "logging": {"file": str(tmp_path / "logs" / "run.log"), "console": False, "level": "WARNING"}})
    logger = settings.start_logging(own)
    assert len(logger.handlers) == 1 and len(settings.start_logging(own).handlers) == 1
    logger.info("quiet")
    logger.warning("loud")
    assert "loud" in (text := (tmp_path / "logs" / "run.log").read_text()) and "quiet" not in text and logger.level == logging.WARNING
    assert settings.run_result("a", 5, 5, 1.0, None, "x")["completed"] and not settings.run_result("a", 4, 5, 1.0, None, "x")["completed"]


def test_legacy_settings(spark):
    from granary.operators.legacy import legacy_settings

    old = {"VOCAB_SIZE": "10", "N_BLOCKS": "2", "EMBED_DIM": " 8", "ATTN_HEADS": "2", "FFN_DIM": "6", "SEQ_LEN": "16", "ROPE_BASE": "10000", "QK_NORM": " Yes ", "OTHER": "1"}
    runs = {"good": old, "bad": old | {"QK_NORM": "maybe", "N_BLOCKS": "2.5"}, "short": {k: v for k, v in old.items() if k != "SEQ_LEN"}, "none": {"seq_len": "3"}}
    recorded = spark.createDataFrame([(run, k, v) for run, own in runs.items() for k, v in own.items()], "run string, key string, value string")
    weights = [("good", "layers.0.attn.q_proj.weight", 8), ("good", "layers.0.ca.weight", 3), ("good", "layers.1.cc.weight", 3), ("bad", "a.ca.weight", 3), ("bad", "a.attn.cb.weight", 4), ("bad", "a.attn.q_proj.bias", 8), ("stray", "x", 1)]
    found = {(r["run"], r["name"]): r for r in legacy_settings(recorded, spark.createDataFrame(weights, "run string, name string, last_size int")).collect()}
    good = {name: (r["value"], r["inferred"]) for (run, name), r in found.items() if run == "good"}
    assert good == {
        "vocab_size": ("10", False), "n_blocks": ("2", False), "embed_dim": ("8", False), "attn_heads": ("2", False), "ffn_dim": ("6", False), "seq_len": ("16", False), "rope_base": ("10000.0", False),
        "qk_norm": ("true", False), "split_qkv_projections": ("true", True), "canon_layers": ("true", True), "attn_bias": ("false", True), "canon_kernel_size": ("3", True),
    }
    faults = {key: r["fault"] for key, r in found.items() if r["fault"]}
    assert faults == {
        ("bad", "qk_norm"): "value", ("bad", "n_blocks"): "value", ("bad", "canon_kernel_size"): "kernels", ("short", "seq_len"): "missing",
        **{("none", n): "missing" for n in ("vocab_size", "n_blocks", "embed_dim", "attn_heads", "ffn_dim", "seq_len", "rope_base")},
    }
    assert found["bad", "attn_bias"]["value"] == "true" and found["short", "canon_layers"]["value"] == "false" and not any(run == "stray" for run, _ in found)


def test_commands(spark, tmp_path, capsys):
    import granary
    from granary.__main__ import main, smoke

    assert granary.corpus_stats is corpus.corpus_stats and all(hasattr(granary, name) for name in granary.__all__)
    assert all(r["ok"] for r in smoke(spark).collect())
    spark.createDataFrame([(i, "word " * (i + 1)) for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = str(tmp_path / "docs")
    assert main(["build", docs, str(tmp_path / "out"), "--target", "s=20", "--target", "l=100", "--shard-tokens", "32", "--dataset-revision", "r1"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"s": {"tokens": 20, "shards": 1}, "l": {"tokens": 100, "shards": 4}}
    assert main(["validate", str(tmp_path / "out"), "s", "l"]) == 0 and main(["validate", str(tmp_path / "out"), "none"]) == 1
    capsys.readouterr()
    assert main(["count", docs, "--sample-docs", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["words"] == 3
    assert main(["sample", docs, str(tmp_path / "sample"), "--byte-budget", "10"]) == 0
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "sample")).orderBy("doc_id").collect()] == ["word", "word word"]
    (tmp_path / "run.toml").write_text('name = "run"\n')
    assert main(["check", str(tmp_path / "run.toml"), "--override", "training.epochs=7"]) == 0 and "epochs = 7" in capsys.readouterr().out
