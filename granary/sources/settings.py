"""A pretraining run's settings: defaults, checks and the migration of old layouts, driven by one list of settings."""

from __future__ import annotations

import copy
import logging
import re
import warnings
from collections.abc import Mapping, Sequence
from logging.handlers import RotatingFileHandler
from pathlib import Path
from typing import Any

from granary.sources import config

#: Section.setting, default, and what it must be: > or >= a bound (and < or <= another), one of some words, or text of some length.
SETTINGS: dict[str, tuple[Any, str]] = {
    "model.vocab_size": (16000, "> 0"), "model.n_blocks": (12, "> 0"), "model.embed_dim": (512, "> 0"), "model.attn_heads": (8, "> 0"), "model.ffn_dim": (1536, "> 0"), "model.seq_len": (1024, "> 0"),
    "model.dropout": (0.0, ">= 0 <= 1"), "model.rope_base": (10000.0, "> 0"), "model.initialization": ("pytorch_default", "pytorch_default|olmo|gpt_scaled"), "model.initialization_std": (0.02, "> 0"),
    "model.qk_norm": (False, ""), "model.split_qkv_projections": (False, ""), "model.canon_layers": (False, ""), "model.attn_bias": (False, ""), "model.canon_kernel_size": (4, "> 0"),
    "optimizer.kind": ("adamw", "adamw|muon_adamw"), "optimizer.lr": (1e-3, "> 0"), "optimizer.norm_lr_multiplier": (1.0, ">= 0"),
    "optimizer.adamw.beta1": (0.9, ">= 0 < 1"), "optimizer.adamw.beta2": (0.95, ">= 0 < 1"), "optimizer.adamw.eps": (1e-8, "> 0"), "optimizer.adamw.weight_decay": (1e-5, ">= 0"), "optimizer.adamw.fused": (True, ""),
    "optimizer.muon.lr_multiplier": (1.0, "> 0"), "optimizer.muon.weight_decay": (0.05, ">= 0"), "optimizer.muon.momentum": (0.95, ">= 0 < 1"), "optimizer.muon.nesterov": (True, ""), "optimizer.muon.adjust_lr_fn": ("match_rms_adamw", "original|match_rms_adamw"),
    "optimizer.muon.eps": (1e-7, "> 0"), "optimizer.muon.ns_iters": (5, "> 0 < 100"), "optimizer.muon.ns_coefficients": ([3.4445, -4.775, 2.0315], ""),
    "optimizer.schedule.kind": ("cosine", "cosine|wsd"), "optimizer.schedule.min_lr": (0.0, ">= 0"), "optimizer.schedule.warmup_steps": (10, ">= 0"), "optimizer.schedule.decay_fraction": (0.2, "> 0 <= 1"),
    "train_dataset.path": ("train_10m", "text"), "validation_dataset.path": ("validation", "text"),
    "training.batch_size": (32, "> 0"), "training.grad_accum_steps": (1, "> 0"), "training.epochs": (1, "> 0"), "training.max_steps": (0, ">= 0"), "training.max_grad_norm": (1.0, "> 0"), "training.z_loss_coefficient": (0.0, ">= 0"), "training.seed": (42, ">= 0"),
    "evaluation.interval_steps": (20, "> 0"), "evaluation.steps": (20, "> 0"),
    "runtime.dataset_dir": ("artifacts/datasets", "text"), "runtime.output_dir": ("artifacts/runs", "text"), "runtime.runs_csv": ("artifacts/results/pretrain_runs.csv", "text"), "runtime.num_workers": (4, ">= 0"), "runtime.pin_memory": (True, ""),
    "runtime.persistent_workers": (True, ""), "runtime.prefetch_factor": (2, "> 0"), "runtime.compile_model": (True, ""), "runtime.compile_mode": ("default", "default|reduce-overhead|max-autotune|max-autotune-no-cudagraphs"),
    "logging.level": ("INFO", "TRACE|DEBUG|INFO|SUCCESS|WARNING|ERROR|CRITICAL"), "logging.console": (True, ""), "logging.file": ("", ""), "logging.rotation": ("10 MB", ""), "logging.retention": ("7 days", ""), "logging.enqueue": (False, ""),
    "logging.tensorboard_flush_secs": (5, "> 0"), "logging.diagnostics_interval": (100, "> 0"), "logging.throughput_interval_steps": (20, "> 0"),
    "checkpoint.interval_steps": (0, ">= 0"), "checkpoint.keep_last": (2, "> 0"), "checkpoint.save_training_state": (True, ""),
}
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\Z")
_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def defaults() -> dict[str, Any]:
    out: dict[str, Any] = {}
    for path, (value, _) in SETTINGS.items():
        *tables, last = path.split(".")
        at = out
        for name in tables:
            at = at.setdefault(name, {})
        at[last] = copy.deepcopy(value)
    return out


def _check(path: str, value: Any, default: Any, rule: str) -> Any:
    kind = type(default)
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind or (kind is float and not abs(value) < float("inf")):
        raise ValueError(f"{path} must be of type {kind.__name__}: {value!r}")
    if kind is list and (len(value) != len(default) or not all(type(x) in (int, float) for x in value)):
        raise ValueError(f"{path} must be {len(default)} numbers")
    if "|" in rule and value not in rule.split("|"):
        raise ValueError(f"{path} must be one of {rule}: {value!r}")
    if rule == "text" and not value:
        raise ValueError(f"{path} must not be empty")
    if rule[:1] in ("<", ">"):
        words = rule.split()
        for sign, bound in zip(words[::2], words[1::2], strict=True):
            if not _COMPARE[sign](value, float(bound)):
                raise ValueError(f"{path} must be {sign} {bound}: {value!r}")
    return value


#: Where settings were, and where they are now.
MOVES = (("data.train", "train_dataset.path"), ("data.validation", "validation_dataset.path"), ("schedule", "optimizer.schedule"))


def migrated(data: Mapping[str, Any]) -> dict[str, Any]:
    """Settings of old places at their new ones; what is set in the new place wins, as the later layer."""
    stays, moved = list(config.leaves(data)), []
    for old, new in ((tuple(a.split(".")), tuple(b.split("."))) for a, b in MOVES):
        found = [(p, v) for p, v in stays if p[: len(old)] == old]
        if found:
            warnings.warn(f"{'.'.join(old)} is now {'.'.join(new)}", stacklevel=3)
            moved += [(new + p[len(old) :], v) for p, v in found]
            stays = [x for x in stays if x not in found]
    return config.fold((config.nested(moved), config.nested(stays)))


def validated(data: Mapping[str, Any]) -> dict[str, Any]:
    """All settings with their defaults, checked one by one and together; unknown ones stay, with a warning."""
    data = migrated(data)
    known = {"name": "", **defaults()}
    for path in config.unknown(data, known):
        warnings.warn(f"unknown setting {path}", stacklevel=2)
    out = config.merge(known, data)
    for path, (default, rule) in SETTINGS.items():
        *tables, last = path.split(".")
        at: Any = out
        for name in tables:
            at = at[name]
            if not isinstance(at, Mapping):
                raise ValueError(f"{path}: {name} must be a table")
        at[last] = _check(path, at[last], default, rule)
    if not isinstance(out["name"], str) or not NAME.match(out["name"]):
        raise ValueError(f"name must start with a letter or digit and be safe as a file's: {out['name']!r}")
    model, optimizer, cap = out["model"], out["optimizer"], out["training"]["max_steps"]
    if model["embed_dim"] % model["attn_heads"] or model["embed_dim"] // model["attn_heads"] % 2:
        raise ValueError("model.embed_dim must give each head an even whole dimension")
    if optimizer["schedule"]["min_lr"] > optimizer["lr"]:
        raise ValueError("optimizer.schedule.min_lr must not exceed optimizer.lr")
    if cap and optimizer["schedule"]["warmup_steps"] >= cap:
        raise ValueError("optimizer.schedule.warmup_steps must be under training.max_steps")
    return out


def load(path: str, overrides: Sequence[str] = (), extends: Sequence[str] = ()) -> dict[str, Any]:
    """A file with its includes, then overrides of known or present settings, then defaults and checks."""
    data = migrated(config.load(path, extends))
    changes = config.overrides(overrides)
    whole = config.apply(config.merge({"name": "", **defaults()}, data), changes)
    return validated(whole)


def parameter_count(model: Mapping[str, Any]) -> int:
    """Trainable parameters of the decoder that model settings describe: tied embeddings, attention, gated feed-forward with biases, norms."""
    d, f, heads = model["embed_dim"], model["ffn_dim"], model["attn_heads"]
    block = 4 * d * d + 3 * d * f + 2 * f + d + 2 * d
    block += 4 * d * model["attn_bias"] + 2 * (d // heads) * model["qk_norm"]
    block += model["canon_kernel_size"] * (2 * d + 3 * d + 2 * f) * model["canon_layers"]
    return model["vocab_size"] * d + model["n_blocks"] * block + d


def find_checkpoint(folder: str | Path, chosen: str | None = None, suffix: str = "pt") -> Path:
    """The file that is named, or the latest managed one, or the only other one."""
    folder = Path(folder)
    if not folder.is_dir():
        raise NotADirectoryError(str(folder))
    if chosen:
        path = folder / Path(chosen).expanduser()  # an absolute one stays as it is
        if not path.is_file():
            raise FileNotFoundError(str(path))
        return path
    rank = lambda p: (re.fullmatch(rf"step_[0-9]+\.{suffix}", p.name) is not None, p.stat().st_mtime_ns, p.name)
    at = next(f for f in (folder / "checkpoints", folder) if f.is_dir())
    ranked = sorted((rank(p), p) for p in at.glob(f"*.{suffix}") if p.is_file())
    if not ranked:
        raise FileNotFoundError(f"no checkpoints in {at}")
    (managed, *_), best = ranked[-1]
    if not managed and len(ranked) > 1:
        raise ValueError(f"several checkpoints in {at}; choose one")
    return best


#: Blocks, width, heads and feed-forward width of each size of model; all have sequences of 1024.
SIZES = {"10m": (8, 256, 4, 704), "20m": (8, 384, 6, 1024), "35m": (11, 448, 7, 1216), "50m": (16, 512, 8, 1344), "100m": (18, 640, 10, 1728)}
#: Of each tuned size the rate, the schedule's decay fraction, AdamW's beta2 and decay, Muon's rate multiplier and decay.
TUNED = {
    "10m": (0.0024, 0.4, 0.99, 0.05, 0.5, 0.05), "20m": (0.0023, 0.4, 0.99, 0.1, 0.5, 0.1),
    "35m": (0.00242, 0.4, 0.99, 0.05, 1.0, 0.0375), "50m": (0.0021, 0.2, 0.9025, 0.05, 0.5, 0.05),
}
#: What all tuned sizes share.
TUNED_ALIKE = {
    "model": {"vocab_size": 16384, "rope_base": 10000.0, "initialization": "gpt_scaled", "initialization_std": 0.02, "qk_norm": True, "split_qkv_projections": True, "dropout": 0.0},
    "optimizer": {"kind": "muon_adamw", "schedule": {"min_lr": 0.0, "kind": "wsd", "warmup_steps": 219}, "adamw": {"beta1": 0.9, "eps": 1e-8}},
    "training": {"batch_size": 16, "grad_accum_steps": 1, "max_grad_norm": 1.0, "z_loss_coefficient": 0.0},
    "evaluation": {"interval_steps": 149, "steps": 7}, "logging": {"diagnostics_interval": 30},
}


def preset(name: str) -> dict[str, Any]:
    """The settings of a size ("35m") or a tuned size ("35m_tuned")."""
    size, _, kind = name.partition("_")
    if size not in SIZES or kind not in ("", "tuned") or (kind and size not in TUNED):
        raise ValueError(f"no preset {name!r}")
    own = {"model": dict(zip(("n_blocks", "embed_dim", "attn_heads", "ffn_dim"), SIZES[size], strict=True)) | {"seq_len": 1024}}
    if not kind:
        return own
    rate, decay_fraction, beta2, decay, multiplier, muon_decay = TUNED[size]
    tuned = {"lr": rate, "schedule": {"decay_fraction": decay_fraction}, "adamw": {"beta2": beta2, "weight_decay": decay}, "muon": {"lr_multiplier": multiplier, "weight_decay": muon_decay}}
    return config.fold((own, TUNED_ALIKE, {"optimizer": tuned}))


class Settings(dict):
    """A checked configuration: from and to dictionaries, text and files."""

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Settings:
        return cls(validated(data))

    @classmethod
    def from_string(cls, text: str) -> Settings:
        return cls.from_dict(config.parse(text))

    @classmethod
    def load(cls, path: str | Path, overrides: Sequence[str] = (), extends: Sequence[str] = ()) -> Settings:
        return cls(load(str(path), overrides, extends))

    def to_dict(self) -> dict[str, Any]:
        return copy.deepcopy(dict(self))

    def to_string(self) -> str:
        """One line, which from_string() reads back."""
        return config.compact(self)

    def to_toml(self) -> str:
        return config.dump(self)

    def with_overrides(self, *groups: str) -> Settings:
        return Settings.from_dict(config.apply(self, config.overrides(groups)))

    def save(self, path: str | Path) -> None:
        """Checks again, as values may have been changed, and replaces the file at once."""
        config.save(validated(self), path)


def start_logging(settings: Mapping[str, Any]) -> logging.Logger:
    """The package's logger with just the sinks of the logging section: the console, and a file that starts anew at the rotation's size."""
    own = settings["logging"]
    logger = logging.getLogger("granary")
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    logger.setLevel({"TRACE": logging.DEBUG, "SUCCESS": logging.INFO}.get(own["level"], own["level"]))
    sinks: list[logging.Handler] = [logging.StreamHandler()] if own["console"] else []
    if own["file"]:
        path = Path(own["file"]).expanduser()
        path.parent.mkdir(parents=True, exist_ok=True)
        number, unit = re.fullmatch(r"\s*(\d+)\s*([KMG]?)B\s*", own["rotation"]).groups()
        sinks.append(RotatingFileHandler(path, maxBytes=int(number) * 1000 ** " KMG".index(unit or " "), backupCount=7, encoding="utf-8"))
    for sink in sinks:
        sink.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(sink)
    return logger


def run_result(name: str, step: int, total: int, train_loss: float | None, validation_loss: float | None, checkpoint: str | Path) -> dict[str, Any]:
    """What a finished or stopped run reports."""
    return {"name": name, "completed": step == total, "global_step": step, "total_steps": total, "train_loss": train_loss, "validation_loss": validation_loss, "checkpoint": str(checkpoint)}
