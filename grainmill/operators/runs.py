"""Runs: presets, batches, schedules, checkpoints, configurations, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY, CONTEXT = 50304, 1024
REQUIRED = ("model", "config", "step", "val_loss")
REQUIRED_2 = ("optimizer", "rank_states", "training", "target_steps")
#: Files that an export must have beside its weights, and the patterns of those that may be published.
FILES = ("README.md", "config.json", "tokenizer_config.json", "training_metadata.json")
PUBLIC = ("*.safetensors", "*.json", "merges.txt", "vocab.txt", "tokenizer.model", "README.md", "log.txt", "training_state.pt")
#: Causal masks that some exports list among the weights.
BUFFERS = (".attn.bias", ".attn.masked_bias")
#: Matrices that an export holds transposed.
TRANSPOSED = ("attn.c_attn.weight", "attn.c_proj.weight", "mlp.c_fc.weight", "mlp.c_proj.weight")


def presets(spark: SparkSession) -> DataFrame:
    """(name, layers, heads, width)."""
    return spark.sql("SELECT * FROM VALUES ('small', 6, 6, 384), ('medium', 8, 8, 512), ('gpt2', 12, 12, 768) AS t(name, layers, heads, width)")


def parameters(layers: Column, width: Column) -> Column:
    """Weights of a decoder with a tied head: embeddings, layers, last norm."""
    return width * VOCABULARY + width * CONTEXT + layers * (12 * width * width + 13 * width) + 2 * width


def preset(spark: SparkSession, name: str) -> DataFrame:
    """The preset of a name; an error for a name that there is none of."""
    known = [r["name"] for r in presets(spark).select("name").collect()]
    if name not in known:
        raise ValueError(f"Unknown model size {name!r}; choose one of {', '.join(known)}")
    return presets(spark).where(F.col("name") == name)


def preset_name(configs: DataFrame) -> DataFrame:
    """configs (…, layers, heads, width) with the column name: of the preset they equal, else custom."""
    known = presets(configs.sparkSession)
    return configs.drop("name").join(F.broadcast(known), ["layers", "heads", "width"], "left").withColumn("name", F.coalesce("name", F.lit("custom"))).select(*(c for c in configs.columns if c != "name"), "name")


def architecture(requested: tuple[int, int, int] | None, saved: tuple[int, int, int] | None, default: tuple[int, int, int]) -> tuple[int, int, int]:
    """(layers, heads, width) of a run: those saved, which a request must not contradict, else those requested, else the default."""
    if saved is not None and requested is not None and saved != requested:
        raise ValueError(f"the checkpoint's architecture is {saved}, {requested} was asked for")
    return saved or requested or default


def location(name: Column) -> Column:
    """The folder of a run's logs: small and medium have their own."""
    return F.when(name.isin("small", "medium"), F.concat(F.lit("log/"), name)).otherwise("log")


def weights(configs: DataFrame) -> DataFrame:
    """(name, weight, shape) of each weight of the decoders configs (name, layers, width); the head is the embedding."""
    c = F.col("width")

    def rows(prefix: Column, kinds: list[tuple[str, list]]) -> Column:
        return F.array(*[F.struct(F.concat(prefix, F.lit(k)).alias("weight"), F.array(*[F.lit(x) if isinstance(x, int) else x.cast("int") for x in shape]).alias("shape")) for k, shape in kinds])

    layer = [("ln_1.weight", [c]), ("ln_1.bias", [c]), ("attn.c_attn.weight", [3 * c, c]), ("attn.c_attn.bias", [3 * c]), ("attn.c_proj.weight", [c, c]), ("attn.c_proj.bias", [c])]
    layer += [("ln_2.weight", [c]), ("ln_2.bias", [c]), ("mlp.c_fc.weight", [4 * c, c]), ("mlp.c_fc.bias", [4 * c]), ("mlp.c_proj.weight", [c, 4 * c]), ("mlp.c_proj.bias", [c])]
    ends = [("wte.weight", [VOCABULARY, c]), ("wpe.weight", [CONTEXT, c]), ("ln_f.weight", [c]), ("ln_f.bias", [c])]
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.col("layers") - 1), lambda k: rows(F.concat(F.lit("h."), k.cast("string"), F.lit(".")), layer)))
    return configs.select("name", F.inline(F.concat(rows(F.lit(""), ends), blocks)))


def decay_groups(made: DataFrame) -> DataFrame:
    """(name, decayed, tensors, parameters) of weights(): matrices are decayed, biases and norms aren't."""
    numel = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return made.groupBy("name", (F.size("shape") >= 2).alias("decayed")).agg(F.count(F.lit(1)).alias("tensors"), F.sum(numel).alias("parameters"))


def export_problems(source: DataFrame, target: DataFrame) -> DataFrame:
    """(weight, problem) of the weights of an export, target (weight, shape), that source (weight, shape) lacks or has in another
    shape; linear matrices are transposed in an export, and its causal masks aren't weights."""
    ends = lambda names: F.lit(False) if not names else F.greatest(*[F.col("weight").endswith(x) for x in names])
    want = target.where(~ends(BUFFERS)).select("weight", F.col("shape").alias("want"))
    have = source.select("weight", F.when(ends(TRANSPOSED), F.reverse("shape")).otherwise(F.col("shape")).alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), F.concat(F.to_json("have"), F.lit(" != "), F.to_json("want")))
    return want.join(have, "weight", "left").select("weight", problem.alias("problem")).where("problem is not null")


def batch_plan(total: int, batch: int, context: int, world: int) -> int:
    """Micro steps of an update."""
    if batch <= 0 or total % (batch * context * world):
        raise ValueError("the total batch size must be a multiple of B * T * world_size")
    return total // (batch * context * world)


def events(steps: DataFrame, last: int, resumed: int | None = None, every: int = 250, save: int = 5000) -> DataFrame:
    """(step, evaluate, sample, checkpoint) of steps at which anything happens besides training; nothing at a resumed boundary."""
    s, end = F.col("step"), F.col("step") == last
    free = F.lit(True) if resumed is None else s != resumed
    out = steps.select("step", (free & ((s % every == 0) | end)).alias("evaluate"), (free & (s > 0) & ((s % every == 0) | end)).alias("sample"), (free & (s > 0) & ((s % save == 0) | end)).alias("checkpoint"))
    return out.where("evaluate or sample or checkpoint")


def newest(checkpoints: DataFrame, config: Column) -> DataFrame:
    """The checkpoint (path, step, config) with this config and the most steps, of ties the first path."""
    return checkpoints.where(F.col("config").eqNullSafe(config)).orderBy(F.desc("step"), "path").limit(1)


def validated(checkpoints: DataFrame) -> DataFrame:
    """(path, problem) of (path, keys array, version, step): null where a checkpoint is sound."""
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("keys"))
    more = F.array_except(F.array(*map(F.lit, REQUIRED_2)), F.col("keys"))
    problem = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ",")))
        .when(F.col("version").isNotNull() & (F.col("version") != 2), "version")
        .when(F.col("step").isNull() | (F.col("step") < 0), "step")
        .when((F.col("version") == 2) & (F.size(more) > 0), F.concat(F.lit("missing "), F.array_join(F.array_sort(more), ",")))
    )
    return checkpoints.select("path", problem.alias("problem"))


def config_diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(key, saved, current) of the keys (key, value) of either side whose values differ, a missing one as null."""
    both = saved.select("key", F.col("value").alias("saved")).join(current.select("key", F.col("value").alias("current")), "key", "full")
    return both.where(~F.col("saved").eqNullSafe(F.col("current"))).orderBy("key")


def manifest(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, missing, weights, complete) of an export's files (*by, name)."""
    names = files.groupBy(*by).agg(F.collect_set("name").alias("n"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, FILES)), "n"))
    has = F.exists("n", lambda x: x.endswith(".safetensors"))
    return names.select(*by, F.array_join(missing, ",").alias("missing"), has.alias("weights"), ((F.size(missing) == 0) & has).alias("complete"))


def allowed(files: DataFrame, patterns: Sequence[str] = PUBLIC) -> DataFrame:
    """The files (name) that one of the patterns matches, in which * stands for any characters."""
    every = "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) for p in patterns)
    return files.where(F.col("name").rlike(rf"(?s)\A(?:{every})\z"))


def publication(files: DataFrame, resumable: bool, step: int) -> DataFrame:
    """(name, action) for an export's files: upload what may be published, delete a stale training state; an error where the
    manifest isn't complete. The commit's message is the column message."""
    state = manifest(files).first()
    if not state.complete:
        raise ValueError(f"Incomplete model export: {state.missing or 'no weights'}")
    up = allowed(files).select("name", F.lit("upload").alias("action"))
    stale = files.sparkSession.createDataFrame([] if resumable else [("training_state.pt", "delete")], "name string, action string")
    return up.unionByName(stale).withColumn("message", F.lit(f"after {step} optimizer updates"))


def metadata(exports: DataFrame) -> DataFrame:
    """(json) of exports (model_size, parameter_count, step, val_loss, dataset, dataset_revision, tokenizer, resumable): the
    record that goes with an export, ten keys each."""
    return exports.select(
        F.to_json(
            F.struct(
                "model_size", "parameter_count", F.col("step").alias("optimizer_steps_completed"), F.col("val_loss").alias("validation_loss"), "dataset", "dataset_revision", "tokenizer",
                F.lit("random").alias("initialization"), F.lit("fixed 20-batch window").alias("validation_scope"), "resumable",
            ),
            {"ignoreNullFields": "false"},
        ).alias("json")
    )


def card(exports: DataFrame) -> DataFrame:
    """(model_size, text) of exports: a short card in Markdown with the figures of the record."""
    state = F.when(F.col("resumable"), "It can be resumed from.").otherwise("It serves inference only.")
    lines = ["# %s", "", "- Parameters: %,d", "- Completed updates: %d", "- Validation cross-entropy: %.4f nats a token", "- Dataset: %s at `%s`", "", "%s"]
    return exports.select("model_size", F.format_string("\n".join(lines), F.coalesce("model_size", F.lit("custom")), "parameter_count", "step", "val_loss", "dataset", "dataset_revision", state).alias("text"))


def effective(defaults: DataFrame, saved: DataFrame, given: DataFrame) -> DataFrame:
    """(key, value, origin) of settings (key, value): what is given goes before what was saved, and that before the default.
    A null value doesn't count as one."""
    out = defaults.select("key", F.col("value").alias("_d"))
    for df, name in ((saved, "_s"), (given, "_g")):
        out = out.join(df.select("key", F.col("value").alias(name)), "key", "full")
    origin = F.when(F.col("_g").isNotNull(), "given").when(F.col("_s").isNotNull(), "saved").otherwise("default")
    return out.select("key", F.coalesce("_g", "_s", "_d").alias("value"), origin.alias("origin"))


def check_flags(upload: str, private: str, batch: int, last: int | None) -> None:
    """An error that names the first setting out of its range."""
    for name, value in (("upload", upload), ("private", private)):
        if value not in ("0", "1"):
            raise ValueError(f"{name} must be 0 or 1, not {value!r}")
    if batch <= 0:
        raise ValueError("the batch size must be positive")
    if last is not None and last < 1:
        raise ValueError("there must be at least one step")


def check_resume(saved: DataFrame, current: DataFrame, ranks: int, world: int) -> None:
    """An error that names the settings (key, value) in which a run differs from the one it resumes, or lacks a rank's state."""
    differ = [r["key"] for r in config_diff(saved, current).select("key").collect()]
    if differ:
        raise ValueError(f"Resume configuration changed: {', '.join(differ)}")
    if ranks != world:
        raise ValueError("Checkpoint has incomplete per-rank state")


def require_unused(spark: SparkSession, folder: str) -> None:
    """An error where a folder holds checkpoints or a log that isn't empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return
    for x in fs.listStatus(where):
        name = x.getPath().getName()
        if re.fullmatch(r"model_.*\.pt", name) or (name == "log.txt" and x.getLen() > 0):
            raise FileExistsError(f"Existing checkpoints or metrics in {folder}")


def save_once(df: DataFrame, path: str) -> None:
    """Write a table where none is yet: under another name first, moved into place when whole."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(path + ".tmp")
    if fs.exists(to) or not fs.rename(tmp, to):
        raise FileExistsError(path)
