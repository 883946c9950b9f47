"""Logs that runs append to: metrics and samples, from batches and from streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.monitor import formatted


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(value) of metrics (step, metric, value): one line of a log each."""
    return metrics.select(formatted(F.col("step"), F.col("metric"), F.col("value")).alias("value"))


def sample_text(step: Column, sample: Column, text: Column) -> Column:
    """What a samples log says of one sample; an empty line parts it from the next."""
    return F.format_string("step %d sample %d: %s\n", step, sample, text)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add lines to a log folder, whose files together are the log."""
    metric_lines(metrics).write.mode("append").text(path)


def append_samples(samples: DataFrame, path: str) -> None:
    """Add samples (step, sample, text) to a samples folder."""
    samples.select(sample_text(F.col("step"), F.col("sample"), F.col("text")).alias("value")).write.mode("append").text(path)


def metrics_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch is a folder of its own, written anew if the batch is run again, so a stream
    that is restarted leaves every line once."""

    def write(batch: DataFrame, number: int) -> None:
        metric_lines(batch).write.mode("overwrite").text(f"{path}/batch={number}")

    return write
