"""Model settings of old runs, from records and weights as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.settings import SETTINGS

#: The words of a truth value, and the settings that weights can't tell.
TRUE, FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")
REQUIRED = ("vocab_size", "n_blocks", "embed_dim", "attn_heads", "ffn_dim", "seq_len", "rope_base")
#: A flag is set where any weight's name holds the text.
IN_NAME = {"split_qkv_projections": r"\.attn\.q_proj\.weight", "qk_norm": r"\.attn\.q_norm\.weight", "canon_layers": r"\.ca\.weight", "attn_bias": r"\.attn\.(c_attn|q_proj|c_proj)\.bias$"}
#: Names of the weights whose last size is the kernel's.
KERNELS = r"(\.ca|\.attn\.cb|\.cc|\.ffn\.cd)\.weight$"


def kinds() -> dict[str, str]:
    """Each setting of a model with "bool", "int", "float" or "str"."""
    return {path.removeprefix("model."): type(value).__name__ for path, (value, _) in SETTINGS.items() if path.startswith("model.")}


def legacy_settings(recorded: DataFrame, weights: DataFrame) -> DataFrame:
    """run, name, value (as text), inferred, fault: the settings of each run that has records.

    recorded: run, key, value, keys in upper case as old runs wrote them, others are left out. weights: run, name, last_size.
    What is recorded is read by its setting's kind (fault "value" where it can't be); flags and the kernel's size that are
    not come from the weights' names and sizes (fault "kernels" where sizes differ); what neither tells has fault "missing".
    """
    kind = F.create_map(*[F.lit(x) for pair in kinds().items() for x in pair])[F.col("name")]
    text = F.trim("value")
    truth = F.when(F.lower(text).isin(*TRUE), "true").when(F.lower(text).isin(*FALSE), "false")
    value = F.when(kind == "bool", truth).when(kind == "int", text.try_cast("long").cast("string")).when(kind == "float", text.try_cast("double").cast("string")).otherwise(text)
    known = recorded.filter(F.upper("key") == F.col("key")).select("run", F.lower("key").alias("name"), "value").filter(F.col("name").isin(*kinds()))
    known = known.select("run", "name", value.alias("value"), F.lit(False).alias("inferred")).withColumn("fault", F.when(F.col("value").isNull(), "value"))
    sizes = F.collect_set(F.when(F.col("name").rlike(KERNELS), F.col("last_size")))
    flags = weights.groupBy("run").agg(*[F.bool_or(F.col("name").rlike(pattern)).alias(flag) for flag, pattern in IN_NAME.items()], sizes.alias("kernels"))
    runs = recorded.select("run").distinct()
    told = [F.struct(F.lit(flag).alias("name"), F.coalesce(F.col(flag), F.lit(False)).cast("string").alias("value"), F.lit(None).cast("string").alias("fault")) for flag in IN_NAME]
    many = F.size("kernels") > 1
    kernel = F.struct(F.lit("canon_kernel_size").alias("name"), F.when(F.size("kernels") == 1, F.get("kernels", F.lit(0)).cast("string")).alias("value"), F.when(many, "kernels").alias("fault"))
    inferred = runs.join(flags, "run", "left").select("run", F.explode(F.array(*told, kernel)).alias("x")).select("run", "x.*").filter("value is not null or fault is not null")
    inferred = inferred.join(known.select("run", "name"), ["run", "name"], "left_anti").select("run", "name", "value", F.lit(True).alias("inferred"), "fault")
    wanted = runs.select("run", F.explode(F.array(*map(F.lit, REQUIRED))).alias("name"))
    missing = wanted.join(known.select("run", "name"), ["run", "name"], "left_anti").select("run", "name", F.lit(None).cast("string").alias("value"), F.lit(False).alias("inferred"), F.lit("missing").alias("fault"))
    return known.unionByName(inferred).unionByName(missing)
