"""Corpus shards: which files, which rows, from which position on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import not_blank


def files(spark: SparkSession, folder: str) -> list[str]:
    """The folder's Parquet files by name, listed once: what a snapshot is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(x.getPath().toString()) for x in fs.listStatus(path) if x.getPath().getName().endswith(".parquet"))


def shards(names: list[str], split: str) -> list[str]:
    """The files of a split, in order."""
    own = [n for n in sorted(names) if n.rsplit("/", 1)[-1].startswith(f"{split}-")]
    if not own:
        raise ValueError(f"No Parquet files for split {split!r}")
    return own


SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):/*"


def plain(path: Column) -> Column:
    """A path with one slash after its scheme, as files are named in either way."""
    return F.regexp_replace(path, SCHEME, "$1:/")


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(file, rows before it, its rows) of a folder's files by name: the rows of a table that is a folder, in the order they were written. Only footers are read."""
    rows = spark.read.parquet(folder)
    counts = {r.file: r.n for r in rows.select(plain(F.col("_metadata.file_path")).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, before = [], 0
    for name in sorted(rows.inputFiles()):
        n = counts.get(re.sub(SCHEME, r"\1:/", name), 0)
        out.append((name, before, n))
        before += n
    return out


def records(spark: SparkSession, paths: list[str], after: tuple[int, int] = (0, 0), blank: bool = False) -> DataFrame:
    """(shard, row, text) of the texts that aren't blank, or of all with blank; row counts every row of the shard from 1, so it is the position after the row.

    A shard is a file, or a folder whose files by name follow each other. after: shard and row of the last row that was read. Files before it
    aren't read; the others are one scan, however many there are, whose rows get their shard from a small table of the files.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rest = []  # (file to read, its names with and without escapes, shard, rows of the shard before it)
    for k, p in enumerate(paths):
        if k < after[0]:
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        path = fs.makeQualified(path)
        if fs.getFileStatus(path).isDirectory():
            for name, before, n in _parts(spark, path.toString()):
                if k > after[0] or before + n > after[1]:
                    one = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
                    rest.append((one.toString(), {one.toString(), name}, k, before))
        else:
            rest.append((path.toString(), {path.toString(), path.toUri().toString()}, k, 0))
    if not rest:
        return spark.createDataFrame([], "shard int, row long, text string")
    names = {(x, k, before) for _, both, k, before in rest for x in both}
    table = spark.createDataFrame(sorted(names), "file string, shard int, before long").select(plain(F.col("file")).alias("file"), "shard", "before").distinct()
    rows = spark.read.parquet(*(p for p, _, _, _ in rest)).select(plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("at"), "text")
    rows = rows.join(F.broadcast(table), "file").select("shard", (F.col("before") + F.col("at") + 1).alias("row"), "text")
    if after[1]:
        rows = rows.where((F.col("shard") > after[0]) | (F.col("row") > after[1]))
    return rows if blank else rows.where(not_blank(F.col("text")))


def tail(spark: SparkSession, path: str, size: int = 6000) -> DataFrame:
    """(text, truncated): the last bytes of a file as text."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.decode(F.expr(f"substring(content, greatest(1, cast(length - {size} + 1 as int)), {size})"), "UTF-8").alias("text"), (F.col("length") > size).alias("truncated"))


def checkpoints(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path) of the checkpoint files of several folders, each once, by path. Files aren't opened."""
    names = set()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            names |= {str(x.getPath().toString()) for x in fs.listStatus(path) if re.fullmatch(r"model_.*\.pt", x.getPath().getName())}
    return spark.createDataFrame([(n,) for n in sorted(names)], "path string").orderBy("path")
