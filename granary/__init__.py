"""A PySpark engine for pretraining data; the names below are what most callers need."""

from importlib import import_module

_PLACES = {
    "build_artifacts": "operators.artifacts", "publish": "operators.artifacts", "validate": "operators.artifacts", "artifact_checks": "operators.artifacts",
    "corpus_stats": "operators.corpus", "token_stream": "operators.corpus", "blocks": "operators.corpus", "byte_budget_sample": "operators.corpus",
    "read_blocks": "sources.tokens", "training_blocks": "sources.tokens", "Settings": "sources.settings", "ingest": "streaming.ingest", "ingest_prefix": "streaming.ingest",
    "throughput_windows": "operators.windows", "live_throughput_windows": "operators.windows", "exact_quantiles": "operators.quantiles", "legacy_settings": "operators.legacy",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Looked up when first used, so that importing the package imports nothing else."""
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(f"granary.{_PLACES[name]}"), name)
