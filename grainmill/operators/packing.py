"""From documents to fixed blocks of tokens: offsets, blocks, ranks, epochs, positions to resume from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EOS, not_blank, with_eos, words
from ..sources.tables import written

#: Ids of a bucket of the prefix sum; buckets of buckets are as many.
SPAN = 4096


def tokenized(docs: DataFrame, tokens: Column | None = None, eos: Column | None = None, keep: Sequence[Column] = ()) -> DataFrame:
    """(*keep, doc_id, ids): documents that give tokens, eos at their ends. Each text is cut into tokens once."""
    ids = words(F.col("text")) if tokens is None else tokens
    end = F.lit(EOS) if eos is None else eos
    # a generator's result is bound, so nothing that reads the ids makes them again
    made = F.explode(F.transform(F.array(ids), lambda x: with_eos(x, end))).alias("ids")
    return docs.where(not_blank(F.col("text"))).select(*keep, "doc_id", made).where(F.size("ids") > 0)


def stream(tokens: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """tokens (*by, doc_id, ids) as a table in the shared folder, and its offsets(), which read lengths only."""
    table = written(tokens.select(*by, "doc_id", "ids", F.size("ids").cast("long").alias("n")), "tokens")
    return table, offsets(table, by)


def offsets(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, doc_id, n, off) of tokens (*by, doc_id, n): where each document's tokens begin in the stream by doc_id, one stream for
    each value of by. A prefix sum in three levels on lengths, so no task sorts more than a bucket's rows and the last level
    is N / SPAN^2 rows."""
    rows = tokens.select(*by, "doc_id", "n")
    rows = rows.withColumn("b1", F.expr(f"doc_id div {SPAN}")).withColumn("b2", F.expr(f"doc_id div {SPAN * SPAN}"))
    one = rows.groupBy(*by, "b2", "b1").agg(F.sum("n").alias("n1"))
    two = one.groupBy(*by, "b2").agg(F.sum("n1").alias("n2"))
    two = two.select(*by, "b2", (F.sum("n2").over(Window.partitionBy(*by).orderBy("b2")) - F.col("n2")).alias("o2"))
    one = one.select(*by, "b2", "b1", (F.sum("n1").over(Window.partitionBy(*by, "b2").orderBy("b1")) - F.col("n1")).alias("o1"))
    before = one.join(two, [*by, "b2"]).select(*by, "b1", (F.col("o1") + F.col("o2")).alias("o"))
    within = F.sum("n").over(Window.partitionBy(*by, "b1").orderBy("doc_id")) - F.col("n")
    return rows.withColumn("w", within).join(before, [*by, "b1"]).select(*by, "doc_id", "n", (F.col("w") + F.col("o")).alias("off"))


def _range(size: int) -> tuple[Column, Column]:
    """The first and the last block that a document (n, off) has tokens of."""
    return F.greatest(F.lit(0), F.floor((F.col("off") - 1) / size)), F.floor((F.col("off") + F.col("n") - 1) / size)


def _part(size: int) -> tuple[Column, Column]:
    """From which token of the stream on, and up to which, a document (n, off) is in block."""
    return F.greatest("off", F.col("block") * size), F.least(F.col("off") + F.col("n"), F.col("block") * size + size + 1)


def spans(placed: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, block, docs) of the whole blocks of placed (*by, n, off), docs the number of documents in one: what lengths alone tell."""
    start, stop = _part(size)
    own = placed.select(*by, "n", "off", F.explode(F.sequence(*_range(size))).alias("block"))
    sums = own.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("docs"), F.sum(stop - start).alias("tokens"))
    return sums.where(F.col("tokens") == size + 1).drop("tokens")


def blocks(tokens: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, block, w, docs): the size + 1 tokens from block * size on; following blocks share one token, and what is left over at
    the end goes. Streams of different values of by are packed apart, so no block holds tokens of two.

    The tokens are written once and read once more; their offsets come from lengths."""
    table, placed = stream(tokens, by)
    start, stop = _part(size)
    placed = table.drop("n").join(placed, [*by, "doc_id"]).select(*by, "ids", "off", "n", F.explode(F.sequence(*_range(size))).alias("block"))
    piece = F.slice("ids", (start - F.col("off") + 1).cast("int"), (stop - start).cast("int"))
    whole = placed.select(*by, "block", F.struct(start.alias("s"), piece.alias("p")).alias("x")).groupBy(*by, "block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    out = whole.select(*by, "block", F.flatten(F.col("x.p")).alias("w"), F.size("x").alias("docs"))
    return out.where(F.size("w") == size + 1)


def pairs(packed: DataFrame, size: int) -> DataFrame:
    """(block, x, y): inputs and next tokens."""
    return packed.select("block", F.slice("w", 1, size).alias("x"), F.slice("w", 2, size).alias("y"))


def matrix(values: Column, rows: int, columns: int) -> Column:
    """A flat array as rows arrays of columns values."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(values, r * columns + 1, columns))


def of_rank(packed: DataFrame, rank: int, world: int) -> DataFrame:
    """The blocks of one rank."""
    return packed.where(F.pmod("block", F.lit(world)) == rank)


def epochs(n_blocks: int, world: int, rank: int, batches: DataFrame) -> DataFrame:
    """(batch, epoch, block): which block of which epoch a rank's batches are; batches has the column batch."""
    own = (n_blocks - rank + world - 1) // world
    if own < 1:
        raise ValueError("Split has too few tokens for one training batch")
    return batches.select("batch", F.expr(f"batch div {own}").alias("epoch"), (F.col("batch") % own * world + rank).alias("block"))


def start(batch: int, context: int, rank: int = 0, world: int = 1, split: str = "train") -> dict:
    """The position of a loader that has read nothing, and that a reset goes back to."""
    return {"epoch": 0, "cursor": {"shard": 0, "row": 0}, "pending": [], "next_block": 0, "B": batch, "T": context, "rank": rank, "world_size": world, "split": split}


#: What a saved position must agree on with the loader that resumes from it.
POSITION = ("B", "T", "rank", "world_size", "split")


def check_position(saved: dict, current: dict) -> None:
    """An error that names the first field in which a saved position differs."""
    for name in POSITION:
        if saved.get(name) != current.get(name):
            raise ValueError(f"Loader {name} changed: saved {saved.get(name)}, now {current.get(name)}")


def position(tokens: DataFrame, size: int, next_block: int) -> DataFrame:
    """(next_block, doc_id, pending_from): where to go on after next_block blocks: the document that holds the block's first token, and the token's place in it."""
    at = next_block * size
    placed = stream(tokens)[1]
    return placed.where((F.col("off") <= at) & (F.col("off") + F.col("n") > at)).select(F.lit(next_block).alias("next_block"), "doc_id", (F.lit(at) - F.col("off")).alias("pending_from"))
