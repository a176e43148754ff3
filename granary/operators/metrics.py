"""Metric logs (run, step, value): rolling medians, spike statistics, running figures, registries and retention.

Rolling medians, quantiles, tenths and throughput windows cut a run over tasks. For the other running figures a run is one
partition of a window, which Spark sorts and spills; runs are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.functions.text import python_capitalize
from granary.operators.ordered import fresh, running_total
from granary.operators.quantiles import exact_quantiles
from granary.operators.windows import throughput_windows  # noqa: F401
from granary.sources import config
from granary.sources.files import written

#: Substrings of parameter names, in order, and the group of each.
GRADIENT_GROUPS = (
    (".attn.c_attn.", "attention_qkv"), (".attn.q_proj.", "attention_query"), (".attn.k_proj.", "attention_key"), (".attn.v_proj.", "attention_value"),
    (".attn.c_proj.", "attention_output"), (".ffn.w1.", "ffn_input_gate"), (".ffn.w3.", "ffn_input_gate"), (".ffn.w2.", "ffn_output"),
)
REGISTRY = "experiment_name string, dataset_variant string, train_loss string, validation_loss string, train_script string, model_path string, config string"


def by_step() -> Window:
    return Window.partitionBy("run").orderBy("step")


def indexed(series: DataFrame, runs: int | None = None) -> DataFrame:
    """series with i, a row's place in its run from 0, and n, the run's rows; no task has to hold a run."""
    one = fresh(series, "one")
    rows = running_total(series.withColumn(one, F.lit(1)), ["run", "step"], one, "i", runs).drop(one)
    return rows.join(rows.groupBy("run").agg(F.min("i").alias("first_"), F.count("*").alias("n")), "run").withColumn("i", F.col("i") - F.col("first_")).drop("first_")


def chunked(rows: DataFrame, size: int, before: int, after: int, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fold over chunks of `size` rows of a run with up to `before` and `after` rows on either side; it gets `own`, which are the chunk's."""
    first = F.greatest(F.lit(0), F.floor((F.col("i") - after) / size))
    last = F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("i") + before) / size))
    spread = rows.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("own", F.floor(F.col("i") / size) == F.col("chunk"))
    return spread.groupBy("run", "chunk").applyInPandas(lambda part: fold(part.sort_values("i")), schema)


def rolling_median(series: DataFrame, half: int = 100, *, chunk: int = 100_000, runs: int | None = None) -> DataFrame:
    """Adds median and residual: over `half` steps on either side, as if the first and last value went on.

    A run is cut into chunks with a halo of `half` steps, each folded by a sliding heap, where a framed percentile would sort
    each frame anew.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.flatnonzero(rows["own"].to_numpy())
        lead, tail = half - own[0], half - (len(rows) - 1 - own[-1])  # short only where the run begins or ends
        values = pd.Series(np.pad(rows["value"].to_numpy(), (lead, tail), mode="edge"))
        median = values.rolling(2 * half + 1).median().to_numpy()[2 * half :]
        rows = rows[rows["own"]]
        return rows.assign(median=median, residual=rows["value"].to_numpy() - median)[["run", "step", "value", "median", "residual", "i", "n"]]

    schema = "run string, step long, value double, median double, residual double, i long, n long"
    return chunked(indexed(series.select("run", "step", "value"), runs), chunk, half, half, fold, schema)


def following_means(rows: DataFrame, column: str, following: int, out: str, *, chunk: int = 100_000) -> DataFrame:
    """run, step, column, out: the mean of the next `following` rows of the run, null where there are fewer or one is null. rows have i and n."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        ahead = part[column][::-1].rolling(following).mean()[::-1].shift(-1)
        return part.assign(**{out: ahead})[part["own"].to_numpy()][["run", "step", column, out]]

    return chunked(rows.select("run", "step", column, "i", "n"), chunk, 0, following, fold, f"run string, step long, {column} double, {out} double")


def spike_summary(grad: DataFrame, loss: DataFrame, validation: DataFrame, after_step: int = 1000, limit: float = 1.0, following: int = 20, half: int = 100) -> DataFrame:
    """One row a run. grad, loss and validation are (run, step, value); grad and loss must have the same steps.

    Percentiles are selected exactly over all runs at once; no task holds a run's values.
    """
    resid = following_means(rolling_median(loss, half), "residual", following, "next_mean")
    rows = grad.select("run", "step", F.col("value").alias("grad")).join(resid, ["run", "step"], "full_outer")
    rows = written(rows.withColumn("late", F.col("step") > after_step).withColumn("clipped", (F.col("step") > after_step) & (F.col("grad") > limit)), "spikes")
    spike = lambda c: F.when(F.col("clipped"), F.col(c))
    out = rows.groupBy("run").agg(
        F.count("grad").alias("steps"), F.max(F.when(F.col("late"), F.col("grad"))).alias("max_grad"),
        F.count_if("clipped").alias("clipped_steps"), (100 * F.count_if("clipped") / F.nullif(F.count_if("late"), F.lit(0))).alias("clipped_percent"),
        F.avg(spike("next_mean")).alias("next_loss_residual_mean"),
        F.count_if(F.col("grad").isNull() | F.col("residual").isNull()).alias("unaligned"),
    )
    series = [("late_grad", "late", "grad"), ("late_residual", "late", "residual"), ("clipped_residual", "clipped", "residual")]
    values = rows.select("run", F.explode(F.array(*[F.struct(F.lit(name).alias("of"), F.when(F.col(when), F.col(c)).alias("v")) for name, when, c in series])).alias("x")).select("run", "x.of", "x.v")
    found = exact_quantiles(values, ["run", "of"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    of = lambda name, q: F.max(F.when(F.col("of") == name, F.col(q)))
    found = found.groupBy("run").agg(
        of("late_grad", "p50").alias("median_grad"), of("late_grad", "p99").alias("p99_grad"), of("late_residual", "p95").alias("loss_residual_p95"),
        of("late_residual", "p99").alias("loss_residual_p99"), of("clipped_residual", "p50").alias("loss_residual_at_clipped_median"),
    )
    names = ["run", "steps", "median_grad", "p99_grad", "max_grad", "clipped_steps", "clipped_percent", "loss_residual_p95", "loss_residual_p99", "loss_residual_at_clipped_median", "next_loss_residual_mean", "unaligned"]
    return out.join(found, "run", "left").select(*names).join(increases(validation), "run", "left")


def increases(series: DataFrame) -> DataFrame:
    """Per run: the largest step-to-step change, and how many are over 0."""
    change = series.withColumn("change", F.col("value") - F.lag("value").over(by_step()))
    return change.groupBy("run").agg(F.max("change").alias("largest_increase"), F.count_if(F.col("change") > 0).alias("increases"))


def clip_fraction(series: DataFrame, limit: float) -> DataFrame:
    return series.withColumn("clip_fraction", F.sum((F.col("value") > limit).cast("int")).over(by_step()) / F.col("step"))


def running(series: DataFrame, kind: str, out: str) -> DataFrame:
    """The sum or the minimum of value so far."""
    return series.withColumn(out, {"sum": F.sum, "min": F.min}[kind]("value").over(by_step().rowsBetween(Window.unboundedPreceding, 0)))


def deciles(series: DataFrame, tiles: int = 10) -> DataFrame:
    """run, decile, n, median and p99 over tenths of a run's steps, the first ones a step longer where it does not divide."""
    each, rest = F.floor(F.col("n") / tiles), F.col("n") % tiles
    long = rest * (each + 1)
    tile = F.when(F.col("i") < long, F.floor(F.col("i") / (each + 1))).otherwise(rest + F.floor((F.col("i") - long) / F.greatest(each, F.lit(1))))
    rows = written(indexed(series.select("run", "step", "value")).select("run", (tile + 1).cast("int").alias("decile"), "value"), "deciles")
    found = exact_quantiles(rows, ["run", "decile"], "value", {"median": 0.5, "p99": 0.99})
    return rows.groupBy("run", "decile").agg(F.count("*").alias("n")).join(found, ["run", "decile"], "left")


def spike_score(series: DataFrame, sigmas: float = 7.0, steps: int = 1000) -> DataFrame:
    """Percent of a run's points at least so many deviations from the mean of its last steps."""
    back = by_step().rowsBetween(-(steps - 1), 0)
    far = F.abs(F.col("value") - F.avg("value").over(back)) >= sigmas * F.stddev_pop("value").over(back)
    rows = series.select("run", (far & (F.stddev_pop("value").over(back) > 0)).alias("far"))
    return rows.groupBy("run").agg((100 * F.count_if("far") / F.count("*")).alias("spike_percent"))


def purge_after(metrics: DataFrame, step: int) -> DataFrame:
    """What a resumed run keeps of its log."""
    return metrics.filter(F.col("step") <= step)


def inventory(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run", "tag").agg(F.count("*").alias("n"))


def gradient_group(name: Column) -> Column:
    out = F.when(name == "embeddings.weight", "embeddings")
    for pattern, group in GRADIENT_GROUPS:
        out = out.when(name.contains(pattern), group)
    return out.when(name.contains("_norm.") | (name == "norm.weight"), "norms").otherwise("other")


def optimizer_group(name: Column, dims: Column, muon: bool) -> Column:
    """decay, no_decay, norm or muon of a parameter by its name and number of dimensions."""
    matrix = dims == 2 if muon else dims >= 2
    out = F.when(name.contains("_norm.") | (name == "norm.weight"), "norm").when(matrix & (name != "embeddings.weight"), "muon" if muon else "decay")
    return out.when((dims >= 2) & (name != "embeddings.weight"), "decay").otherwise("no_decay")


def group_norms(gradients: DataFrame) -> DataFrame:
    """group, norm over (name, value) rows; attention_qkv also has what query, key and value have."""
    own = gradient_group(F.col("name"))
    both = F.when(own.isin("attention_query", "attention_key", "attention_value"), F.array(own, F.lit("attention_qkv"))).otherwise(F.array(own))
    return gradients.select(F.explode(both).alias("group"), "value").groupBy("group").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.count("*").alias("n"))


@F.pandas_udf(StringType())
def canonical_config(text: pd.Series) -> pd.Series:
    """A configuration's canonical JSON, whichever form it is written in; what is no TOML stays as it is."""

    def one(value):
        try:
            return json.dumps(config.parse(value or ""), sort_keys=True, default=str)
        except ValueError:
            return value

    return text.map(one)


def new_registry_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose (model_path, configuration) is not there yet, each once; a configuration is the same in any form and order."""
    key = canonical_config(F.coalesce("config", F.lit("")))
    rows = new.select(F.struct("*").alias("row"), "model_path", key.alias("key")).dropDuplicates(["model_path", "key"])
    return rows.join(existing.select("model_path", key.alias("key")).distinct(), ["model_path", "key"], "left_anti").select("row.*")


def format_loss(value: float) -> str:
    return format(value, ".10g")


def retained(files: DataFrame, keep_last: int, just_written: str | None = None) -> DataFrame:
    """path, mtime_ns, keep of managed checkpoint files (path, mtime_ns): in each folder the latest by time, then name; one just written first."""
    managed = files.filter(F.element_at(F.split("path", "/"), -1).rlike(r"^step_[0-9]+\.pt$"))
    own = F.col("path") == F.lit(just_written) if just_written else F.lit(False)
    rank = F.row_number().over(Window.partitionBy(F.regexp_replace("path", "[^/]*$", "")).orderBy(F.desc(own), F.desc("mtime_ns"), F.desc("path")))
    return managed.select("path", "mtime_ns", (rank <= keep_last).alias("keep"))


def selected_results(registry: DataFrame, names: list[str]) -> DataFrame:
    """Losses as numbers and the perplexity of the named runs; all must be there."""
    out = registry.filter(F.col("experiment_name").isin(names)).select(
        "experiment_name", "dataset_variant", F.col("train_loss").cast("double").alias("train_loss"), F.col("validation_loss").cast("double").alias("validation_loss"), F.exp(F.col("validation_loss").cast("double")).alias("perplexity")
    )
    if out.count() != len(names):
        raise ValueError(f"{len(names)} runs are wanted")
    return out


def variant_millions(name: Column) -> Column:
    """The size that a variant's suffix names: _1b is 1000, _300m is 300."""
    return F.when(name.endswith("1b"), 1000).otherwise(F.regexp_extract(name, r"_(\d+)m$", 1).try_cast("int"))


# What a training step logs.

#: The tags of a run's metric log; those that end in a slash begin a family.
TAGS = (
    "train/loss", "train/objective", "train/z_loss", "train/z_loss_contribution", "train/gradient_norm", "train/clip_fraction", "train/gradient_clipped", "train/tokens_seen", "train/learning_rate",
    "train/norm_learning_rate", "train/muon_learning_rate", "train/tokens_per_second", "validation/loss", "diagnostics/parameter_norm", "diagnostics/parameter_rms", "diagnostics/embedding_norm",
    "runtime/cuda_peak_allocated_bytes", "model/parameter_count", "learning_rates/", "gradient_groups/",
)


def known_tag(tag: Column) -> Column:
    families = [t for t in TAGS if t.endswith("/")]
    named = tag.isin([t for t in TAGS if not t.endswith("/")])
    return F.coalesce(named | F.exists(F.lit(families), lambda f: tag.startswith(f) & (F.length(tag) > F.length(f))), F.lit(False))


def step_losses(micro: DataFrame, accumulation: int) -> DataFrame:
    """run, step, loss, batches over (run, micro_batch from 0, loss): the plain mean of each group of `accumulation`; an incomplete last group goes."""
    rows = micro.groupBy("run", (F.floor(F.col("micro_batch") / accumulation) + 1).alias("step")).agg(F.avg("loss").alias("loss"), F.count("*").alias("batches"))
    return rows.filter(F.col("batches") == accumulation)


def parameter_norms(parameters: DataFrame, *by: str) -> DataFrame:
    """norm, rms and numel over (name, value) rows, in all or by the columns named."""
    return parameters.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count("value")).alias("rms"), F.count("value").alias("numel"))


def parameter_totals(parameters: DataFrame) -> DataFrame:
    """total and trainable over (name, numel, trainable)."""
    return parameters.agg(F.coalesce(F.sum("numel"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).alias("trainable"))


def partition_check(parameters: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: parameters, assigned, ungrouped, repeated, unexpected and ok: whether each name of `parameters` is in exactly one row of (name, group)."""
    seen = groups.groupBy("name").agg(F.count("*").alias("times"))
    rows = parameters.select("name", F.lit(True).alias("own")).distinct().join(seen, "name", "full_outer")
    out = rows.agg(
        F.count_if("own").alias("parameters"), F.count("times").alias("assigned"), F.count_if(F.col("times").isNull()).alias("ungrouped"),
        F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("own").isNull()).alias("unexpected"),
    )
    return out.withColumn("ok", (F.col("ungrouped") == 0) & (F.col("repeated") == 0) & (F.col("unexpected") == 0))


def optimizer_names(parameters: DataFrame, groups: DataFrame) -> DataFrame:
    """optimizer, group, names in the group's order: (parameter_id, name) joined to (optimizer, group, position, parameter_id); a parameter's least name counts."""
    named = parameters.groupBy("parameter_id").agg(F.min("name").alias("name"))
    rows = groups.join(named, "parameter_id").groupBy("optimizer", "group")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("names"))


def group_rates(multiplier: Column, rate: float, norm: float, muon: float) -> dict[str, Column]:
    """The rate of each kind of parameter group at a step."""
    return {"rate": multiplier * rate, "norm_rate": multiplier * rate * norm, "muon_rate": multiplier * rate * muon}


def key_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """part, name, fault (missing or unexpected) over (part, name) of two states; none where they have the same keys."""
    mark = lambda df, fault: df.select("part", "name").distinct().withColumn("fault", F.lit(fault))
    return mark(expected, "missing").join(found, ["part", "name"], "left_anti").unionByName(mark(found, "unexpected").join(expected, ["part", "name"], "left_anti"))


#: The sections that a resumed run must share, and the one old setting that does not count.
SIGNED, UNSIGNED = ("model", "optimizer", "training", "evaluation"), ("optimizer.schedule.total_steps",)


def signatures(settings: DataFrame, known: Sequence[str]) -> DataFrame:
    """run, n, signature over (run, path, value): the digest of the known settings that a resumed run must share, in order of their path."""
    signed = [p for p in known if p.split(".")[0] in SIGNED and p not in UNSIGNED]
    line = F.concat_ws("=", "path", "value")
    return settings.filter(F.col("path").isin(signed)).groupBy("run").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("signature"))


def distinct_check(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, n_distinct, ok: whether no value of a group comes twice."""
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"))
    return out.withColumn("ok", F.col("n") == F.col("n_distinct"))


def start_faults(starts: DataFrame, samples: DataFrame, total: int, length: int) -> DataFrame:
    """sample, fault (null where sound) of evaluation samples (sample, sequence_length, block_count) and their (sample, start_token) rows."""
    own = starts.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("start_token").alias("n_distinct"), F.min("start_token").alias("low"), F.max("start_token").alias("high"))
    fault = (
        F.when(F.col("sequence_length") != length, "length")
        .when(F.col("n").isNull(), "empty")
        .when(F.col("n") != F.col("block_count"), "count")
        .when(F.col("n") != F.col("n_distinct"), "repeated")
        .when((F.col("low") < 0) | (F.col("high") + length >= total), "outside")
    )
    return samples.join(own, "sample", "left").select("sample", fault.alias("fault"))


def name_checks(name: Column) -> dict[str, Column]:
    """safe: a run's name that may be a file's; plain: a file name without a folder."""
    plain = (F.length(name) > 0) & ~name.contains("/") & ~name.isin(".", "..")
    return {"safe": F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False)), "plain": F.coalesce(plain, F.lit(False))}


# Reports.


def run_label(name: Column, prefix: str = "35m_", cut: str = "_muon_") -> Column:
    """A run's name without its prefix, up to `cut`, in words, with a capital."""
    rest = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    return python_capitalize(F.replace(F.substring_index(rest, cut, 1), F.lit("_"), F.lit(" ")))


def run_order(runs: DataFrame) -> DataFrame:
    """Adds mix, millions and place: the runs' order by size, then by name, inside a mix (the variant up to its first underscore)."""
    rows = runs.withColumn("mix", F.substring_index("variant", "_", 1)).withColumn("millions", variant_millions(F.col("variant")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("mix").orderBy("millions", "variant", "run")))


def plotted_series(log: DataFrame, tags: Sequence[str]) -> DataFrame:
    """label, tag, step, value of the tags that a figure shows: what a plot would be drawn from."""
    return log.filter(F.col("tag").isin(list(tags))).select(run_label(F.col("run")).alias("label"), "tag", "step", "value")


def as_json(rows: DataFrame) -> DataFrame:
    """json: each row as one JSON object, null fields left out; `write.text` makes the dump."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def reduced(rows: DataFrame, loss: Callable[[pd.DataFrame], float], *by: str) -> DataFrame:
    """by, loss: a caller's function of each group's rows; a group must fit a task, and anything but one number is an error."""
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name in by]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        value = loss(group)
        if np.ndim(value) or isinstance(value, str | bool) or not np.isreal(value):
            raise ValueError(f"a loss is one number, not {value!r}")
        return pd.DataFrame({**{name: group[name].iloc[:1].to_numpy() for name, _ in fields}, "loss": [float(value)]})

    return rows.groupBy(*by).applyInPandas(one, ", ".join(f"`{n}` {k}" for n, k in [*fields, ("loss", "double")]))
