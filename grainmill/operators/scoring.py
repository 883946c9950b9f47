"""Scores of logits: losses, completions, choices, top-k probabilities and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cross_entropy, softmax


def losses(rows: DataFrame) -> DataFrame:
    """rows (…, logits array<double>, target) with the column loss."""
    return rows.withColumn("loss", cross_entropy(F.col("logits"), F.col("target")))


def masked_mean(loss: Column, mask: Column) -> Column:
    """The mean of the losses that the mask keeps; null if it keeps none."""
    return F.sum(F.when(mask != 0, loss)) / F.sum(F.when(mask != 0, F.lit(1)))


def choose(scores: DataFrame) -> DataFrame:
    """(item, choice) of (item, choice, loss): the choice with the least loss, -1 for ties and where a loss isn't a number."""
    ok = F.max(F.isnan("loss") | F.col("loss").isNull())
    one = scores.groupBy("item").agg(F.min(F.struct("loss", "choice")).alias("m"), ok.alias("bad"), F.collect_list("loss").alias("all"))
    ties = F.size(F.filter("all", lambda x: x == F.col("m.loss")))
    return one.select("item", F.when(~F.col("bad") & (ties == 1), F.col("m.choice")).otherwise(F.lit(-1)).alias("choice"))


def top_probabilities(logits: Column, k: int, vocabulary: int | None = None) -> Column:
    """The k largest probabilities with their ids, largest first, of ties the smaller id first. Ids from vocabulary on are padding
    and have no share."""
    real = logits if vocabulary is None else F.slice(logits, 1, vocabulary)
    p = F.transform(softmax(real), lambda x, i: F.struct((-x).alias("p"), i.alias("id")))
    return F.transform(F.slice(F.sort_array(p), 1, k), lambda x: F.struct(x["id"].alias("id"), (-x["p"]).alias("p")))


def sample(df: DataFrame, key: str, k: int, seed: int, vocabulary: int | None = None) -> DataFrame:
    """(key, id): one of the k likeliest ids, drawn by a hash of key and seed against the cumulative probability."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    top = df.select(key, u.alias("u"), F.posexplode(top_probabilities(F.col("logits"), k, vocabulary)).alias("pos", "t"))
    w = Window.partitionBy(key)
    run = top.select(key, "u", "pos", F.col("t.id").alias("id"), F.sum("t.p").over(w.orderBy("pos")).alias("c"), F.sum("t.p").over(w).alias("total"))
    hit = run.where(F.col("c") > F.col("u") * F.col("total"))
    return hit.groupBy(key).agg(F.min_by("id", "pos").alias("id"))


def clip_scale(vector: Column, most: float = 1.0) -> Column:
    """What a gradient is multiplied with so that its norm is at most so much."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.least(F.lit(1.0), most / (norm + 1e-6))
