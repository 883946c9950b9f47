"""Metrics logs: parse, validate, last write wins, series, trailing means, summaries, pruning."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import SPACE, perplexity
from ..sources.corpus import SCHEME, plain

METRICS = ("train", "val", "perplexity", "comprehension_sanity")
_DIGITS = "[0-9]+(_[0-9]+)*"
_INTEGER = f"^[+-]?{_DIGITS}$"
_NUMBER = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
#: Breaks within what a line feed ends; a return before the feed is part of that break.
_INNER = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


#: Steps of a range, and records of a run, of a trailing mean.
SPAN = 4096


def lines(content: Column) -> Column:
    """The complete lines of a log; unless it ends with a line feed, the last is still being written and left out."""
    parts = F.split(content, _BREAKS, -1)
    empty = (F.element_at(parts, -1) == "").cast("int")
    open_ = F.when(content.endswith("\n") | (content == ""), 0).otherwise(1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - empty - open_, F.lit(0)))


def fields(line: Column) -> Column:
    """What white space parts in a line."""
    return F.split(F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")


def _ends(spark: SparkSession, file: str) -> bool:
    """Whether a file is empty or ends with a line feed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(path).getLen()
    if not size:
        return True
    data = fs.open(path)
    try:
        data.seek(size - 1)
        return data.read() == 10
    finally:
        data.close()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a log: a file, or a folder whose files by name follow each other; none where there is no file yet. The last line of a file is
    left out unless it ends with a line feed. Files are read in splits; lines are numbered from the lines of the splits before them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "line_no long, line string")
    text = spark.read.option("lineSep", "\n").text(path)
    names = sorted(text.inputFiles())
    if not names:
        return spark.createDataFrame([], "line_no long, line string")
    text = text.select("value", plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    breaks = text.where(F.col("value").rlike(_INNER)).isEmpty()
    # where a line feed is the only break, a row is a line; else a row's lines are those that breaks part in it
    each = F.array("value") if breaks else F.split("value", _INNER, -1)
    closed = F.array("value") if breaks else F.split(F.regexp_replace("value", r"\r\z", ""), _INNER, -1)
    rows = text.withColumn("own", closed)
    open_ = [re.sub(SCHEME, r"\1:/", n) for n in names if not _ends(spark, n)]
    if open_:
        last = rows.where(F.col("file").isin(open_)).groupBy("file").agg(F.max(F.struct("at", "i")).alias("z")).select(F.col("file").alias("f"), F.col("z.at").alias("a"), F.col("z.i").alias("k"))
        rows = rows.join(F.broadcast(last), (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")) & (F.col("i") == F.col("k")), "left")
        kept = F.slice(each, 1, F.greatest(F.size(each) - 1 - F.when(F.element_at(each, -1) == "", 1).otherwise(0), F.lit(0)))
        rows = rows.withColumn("own", F.when(F.col("f").isNull(), F.col("own")).otherwise(kept))
    rows = rows.select("file", "at", "i", "own", F.size("own").alias("n"))
    sizes = rows.groupBy("file", "at").agg(F.sum("n").alias("c"), F.min("i").alias("first"))
    # a row for each split
    before = sizes.select("file", "at", (F.sum("c").over(Window.orderBy("file", "at")) - F.col("c")).alias("base"), "first")
    rows = rows.join(F.broadcast(before), ["file", "at"])
    if breaks and not open_:
        return rows.select((F.col("base") + F.col("i") - F.col("first")).alias("line_no"), F.element_at("own", 1).alias("line"))
    own = Window.partitionBy("file", "at").orderBy("i")
    start = F.col("base") + F.sum("n").over(own) - F.col("n")
    return rows.withColumn("start", start).select("start", F.posexplode("own").alias("k", "line")).select((F.col("start") + F.col("k")).alias("line_no"), "line")


def parse(log: DataFrame) -> DataFrame:
    """(line_no, step, metric, value, status) of (line_no, line): status valid, invalid or unknown.

    Steps and values are what Python's int() and float() read, in ASCII digits and within 64 bits."""

    def number(at: int, pattern: str, kind: str) -> Column:
        x = F.get("f", F.lit(at))
        return F.when(x.rlike(pattern), F.replace(x, F.lit("_"), F.lit("")).try_cast(kind))

    # a generator's result is bound, so a line is taken apart once
    f = log.select("line_no", F.explode(F.array(fields(F.col("line")))).alias("f"))
    f = f.select("line_no", number(0, _INTEGER, "long").alias("step"), F.get("f", F.lit(1)).alias("metric"), number(2, _NUMBER, "double").alias("value"), (F.size("f") == 3).alias("three"))
    ok = (F.col("step") >= 0) & F.col("value").isNotNull() & (F.abs("value") != float("inf")) & in_domain(F.col("metric"), F.col("value"))
    status = F.when(~F.col("three"), "invalid").when(~F.col("metric").isin(*METRICS), "unknown").when(F.coalesce(ok, F.lit(False)), "valid").otherwise("invalid")
    return f.select("line_no", "step", "metric", "value", status.alias("status"))


def in_domain(metric: Column, value: Column) -> Column:
    """Whether a metric may have this value."""
    return F.when(metric == "comprehension_sanity", value.between(0, 1)).when(metric == "perplexity", value >= 1).otherwise(value >= 0)


def last_wins(metrics: DataFrame) -> DataFrame:
    """One row for each (metric, step): the last line's value, the first line's number and how many were replaced."""
    return metrics.groupBy("metric", "step").agg(F.max_by("value", "line_no").alias("value"), F.min("line_no").alias("first_line"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def backfill(metrics: DataFrame) -> DataFrame:
    """(metric, step, value) with a perplexity for every step that has only a validation loss."""
    have = metrics.where("metric = 'perplexity'").select("step")
    new = metrics.where("metric = 'val'").join(have, "step", "left_anti").select(F.lit("perplexity").alias("metric"), "step", perplexity(F.col("value")).alias("value"))
    return metrics.select("metric", "step", "value").unionByName(new)


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric").agg(F.count(F.lit(1)).alias("records"), F.max("step").alias("latest_step"), F.max_by("value", "step").alias("latest_value"))


def best_step(metrics: DataFrame) -> DataFrame:
    """The step with the least validation loss; of ties the one first written."""
    return metrics.where("metric = 'val'").agg(F.min_by("step", F.struct("value", "first_line")).alias("step"), F.min("value").alias("value"))


def trailing(metrics: DataFrame, window: int = 50) -> DataFrame:
    """(metric, step, mean) of the last window records of a metric, fewer at its start.

    Records are numbered from counts of steps' ranges and dealt into runs of SPAN, each with the window - 1 records
    before it, so a long series is many tasks' work."""
    window = max(1, window)
    span = max(SPAN, window)
    rows = metrics.select("metric", "step", "value", F.expr(f"step div {SPAN}").alias("b"))
    base = rows.groupBy("metric", "b").agg(F.count(F.lit(1)).alias("c"))
    base = base.select("metric", "b", (F.sum("c").over(Window.partitionBy("metric").orderBy("b")) - F.col("c")).alias("base"))
    place = F.row_number().over(Window.partitionBy("metric", "b").orderBy("step")) - 1
    rows = rows.withColumn("k", place).join(base, ["metric", "b"]).withColumn("k", F.col("k") + F.col("base"))
    own = F.floor(F.col("k") / span)
    runs = F.when(F.col("k") % span > span - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("metric", "step", "value", "k", own.alias("own"), F.explode(runs).alias("run"))
    w = Window.partitionBy("metric", "run").orderBy("k").rowsBetween(1 - window, 0)
    return rows.withColumn("mean", F.avg("value").over(w)).where("own = run").select("metric", "step", "mean")


def prune(log: DataFrame, resume: int) -> DataFrame:
    """The lines before resume, and at resume all but training losses: what a run that resumes there keeps."""
    f = log.withColumn("_f", fields(F.col("line")))
    step = F.get("_f", F.lit(0))
    whole = F.when((F.size("_f") == 3) & step.rlike("^[0-9]+$"), step.try_cast("long"))
    return f.where((whole < resume) | ((whole == resume) & (F.get("_f", F.lit(1)) != "train"))).select("line_no", "line")


def changed(log: DataFrame, kept: DataFrame) -> bool:
    """Whether pruning takes anything away, so that the log has to be archived first."""
    return not log.select("line_no", "line").exceptAll(kept).isEmpty()


def prune_file(spark: SparkSession, path: str, resume: int) -> str | None:
    """Prune a log file in place for a run that resumes at a step. Where that takes anything away, the file is first copied
    beside it, and the copy's path is returned. A file that isn't there is made empty. Breaks of lines stay."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        fs.create(at, False).close()
        return None
    kept_breaks = F.regexp_extract_all(F.col("value"), F.lit(rf"(?s).*?(?:{_BREAKS})|.+?\z"), F.lit(0))
    log = spark.read.text(path, wholetext=True).select(F.posexplode(kept_breaks).alias("line_no", "line"))
    kept = prune(log, resume)
    if not changed(log, kept):
        return None
    joined = kept.agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x")).select(F.array_join("x.line", "").alias("t"))
    text = joined.first().t or ""  # before the file is opened
    copy = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"{at.getName().rsplit('.', 1)[0]}.before-resume-{time.time_ns()}.txt")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, fs, copy, False, conf)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return copy.toString()


def formatted(step: Column, metric: Column, value: Column) -> Column:
    """A log line: training losses with six decimals, others with four."""
    return F.when(metric == "train", F.format_string("%d %s %.6f", step, metric, value)).otherwise(F.format_string("%d %s %.4f", step, metric, value))
