import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from grainmill.functions import columns as C
from grainmill.streaming import packer


def test_stream_packs_like_the_batch_and_resumes(spark, tmp_path):
    src, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    src.mkdir()
    spark.dataSource.register(packer.Shards)

    def run():
        docs = spark.readStream.format("shards").option("path", str(src)).option("batch", 1).load()
        ids = C.with_eos(C.words(F.col("text")), F.lit("99"))
        q = packer.packed(docs.select(F.lit("s").alias("stream"), "shard", "row", ids.alias("ids")), 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    pq.write_table(pa.table({"text": ["1 2 3 99", None, "4 5 6"]}), src / "a.parquet", row_group_size=2)
    run()
    pq.write_table(pa.table({"text": ["7 8 9 10 11 12 13 14"]}), src / "b.parquet")
    run()
    flat = "1 2 3 99 4 5 6 99 7 8 9 10 11 12 13 14 99".split()
    got = {r.block: r.w for r in spark.read.parquet(out).collect()}
    assert got == {k: flat[3 * k : 3 * k + 4] for k in range(5)}
