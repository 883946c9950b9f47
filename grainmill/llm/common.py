"""What the operators share: lineage cuts, bounded Bloom prefilters, Arrow helpers."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Bloom prefilter has at most so many 64-bit words (8 MB, for four million keys); beyond that the exact join runs alone.
SIEVE_WORDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="grainmill-")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Paths of the tables that cut() has written, in order.
_written: list[str] = []


def cut(df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables written by cut() that no later step and no result reads, and what finished jobs have shuffled."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            _remove(df.sparkSession, f.rsplit("/", 1)[0])
    if tables:
        give_back(tables[0])


def give_back(df: DataFrame) -> None:
    """Remove what finished jobs have shuffled: Spark removes those files when the driver's JVM finds that nothing refers to them any
    more, so it is asked to look. What the driver itself holds without need goes back to the system, too."""
    df.sparkSession._jvm.System.gc()
    trim(df.sparkSession)


def trim(spark: SparkSession) -> str:
    """Have the driver's JVM and Python give memory back that they have freed but the C library keeps, such as that of the compilers of a
    hundred plans. What the JVM says of it; nothing where it, or the C library, can't."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by reflection on the interface, as the class of the server isn't open to others
        named = jvm.java.lang.Class.forName
        of = array(jvm.java.lang.Class, 4)
        for j, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            of[j] = named(name)
        given = array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(named("javax.management.MBeanServer").getMethod("invoke", of).invoke(server, given))
    except Py4JError:
        return ""


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut(make()); the tables that make has written on the way are removed."""
    mark = len(_written)
    out = cut(make(), name)
    for path in _written[mark:-1]:
        _remove(out.sparkSession, path)
    del _written[mark:-1]
    give_back(out)
    return out


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores as it takes to be no column of the frames."""
    there = {c.lower() for df in frames for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def folded(values: list[int]) -> Column:
    """A constant array<bigint>; the optimizer folds the parsing away."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _mask(key: Column) -> Column:
    h = F.xxhash64(F.lit(9), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 6, 12, 18)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def sieve(keys: DataFrame, n: int) -> Callable[[DataFrame, Column], DataFrame] | None:
    """A Bloom filter of keys' only column, of which there are n, as a table of 64-bit words; None where more than SIEVE_WORDS
    words would be needed.

    It gives a frame the column _hit: true for every value of keys and for a few per cent of the others, false
    for null. A key's four bits are in one word, so a test is one lookup in the broadcast table, whose size is bounded whatever n is.
    """
    words = 1 << max(4, (n // 4).bit_length())
    if words > SIEVE_WORDS:
        return None

    def word(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), key), F.lit(words))

    column = F.col(keys.columns[0])
    table = cut(keys.where(column.isNotNull()).select(word(column).alias("_w"), _mask(column).alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m")), "sieve")

    def flag(df: DataFrame, key: Column) -> DataFrame:
        hit = F.coalesce(F.col("_m").bitwiseAND(_mask(key)) == _mask(key), F.lit(False))
        return df.withColumn("_word", word(key)).join(F.broadcast(table.withColumnRenamed("_w", "_word")), "_word", "left").withColumn("_hit", hit).drop("_word", "_m")

    return flag
