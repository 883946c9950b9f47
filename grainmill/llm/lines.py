"""Fuzzy deduplication of lines by MinHash, in DataFrame operations only."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_WORDS, cut, drop, sieve
from .links import group, shared_keys

#: Characters (UTF-16 code units) of a shingle, minima of a signature, minima of a group, any two of which are a band.
SHINGLE, MINIMA, GROUP = 12, 15, 3
#: A sketch has four bits of each minimum; linked lines agree in so many at least: at a similarity of 0.8 fewer agree once in 150,000 times.
SKETCH = (MINIMA, 4, 5)
#: 64-bit numbers of a line's bitmap.
WORDS = 80
#: What a line that isn't blank holds.
MARK = r"(?U)\S"


def _starts(units: Column) -> Column:
    """The first bytes of the shingles of a line's code units, two bytes each: from every place that SHINGLE units follow, or the first of a
    shorter line."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - F.lit(2 * SHINGLE - 1)), F.lit(2))


def _unit(units: Column, start: Column) -> Column:
    return F.call_function("substring", units, start, F.lit(2 * SHINGLE))


def _hash(units: Column, start: Column) -> Column:
    return F.xxhash64(_unit(units, start))


def shingles(line: Column) -> Column:
    """Hashes of the distinct character shingles of a line: SHINGLE characters from every place, or the whole of a shorter line."""

    # in a lambda the units are made once
    every = F.transform(F.array(F.encode(line, "UTF-16BE")), lambda u: F.transform(_starts(u), lambda i: _hash(u, i)))
    return F.array_distinct(F.element_at(every, 1))


def _masks() -> list[int]:
    """Constants whose first four bits differ, so that their minima are far from each other."""
    r = random.Random(17)
    return [(j << 28 | r.getrandbits(28)) - (1 << 31) for j in range(MINIMA)]


def signatures(hashes: DataFrame) -> DataFrame:
    """(h, m0, m1, …) of hashes (h, x), x an int: the least values of x xor each of MINIMA constants.

    A constant puts evenly spread hashes in an order of its own, by how long a beginning they share with it, so two
    lines have a minimum in common with the probability of their hashes' Jaccard similarity. One aggregation with
    partial sums: equal lines are one, and nothing is sorted.
    """
    least = [F.min(F.col("x").bitwiseXOR(F.lit(c))).alias(f"m{j}") for j, c in enumerate(_masks())]
    return hashes.groupBy("h").agg(*least)


def hashed(lines: DataFrame) -> DataFrame:
    """(h, x): the upper halves of the hashes of all shingles of lines (h, line), repeated ones too. Generated code from the line to the
    partial minima."""
    own = lines.select("h", F.encode("line", "UTF-16BE").alias("units"))
    each = own.select("h", "units", F.explode(_starts(F.col("units"))).alias("i"))
    return each.select("h", F.shiftright(_hash(F.col("units"), F.col("i")), 32).cast("int").alias("x"))


def elements(items: DataFrame) -> DataFrame:
    """(id, n, x): the hashes of all shingles of items (id, item), lines, repeated ones too, n their number. Generated code."""
    own = items.select("id", F.encode("item", "UTF-16BE").alias("units"))
    own = own.select("id", "units", F.greatest(F.lit(1), F.octet_length("units") / 2 - F.lit(SHINGLE - 1)).cast("int").alias("n"))
    each = own.select("id", "n", "units", F.explode(_starts(F.col("units"))).alias("i"))
    return each.select("id", "n", _hash(F.col("units"), F.col("i")).alias("x"))


def banded(signed: DataFrame) -> DataFrame:
    """(id, sk, keys) of signatures: a key for any two minima of each GROUP, and a sketch of the minima. Two lines share no key
    where no group has two minima in common: once in some 80,000 times at a similarity of 0.8."""
    step = MINIMA // GROUP
    pairs = [(i, j) for g in range(step) for i, j in combinations(range(g, MINIMA, step), 2)]
    keys = [F.xxhash64(F.lit(k), f"m{i}", f"m{j}") for k, (i, j) in enumerate(pairs)]
    sketch = F.lit(0).cast("long")
    for j in range(MINIMA):
        sketch = sketch.bitwiseOR(F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit(15)).cast("long"), 4 * j))
    return signed.select(F.col("h").alias("id"), sketch.alias("sk"), F.array(*keys).alias("keys"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, r, line_no, line, h) of the lines that aren't blank: t is a hash of the text, r a number of the row, h a hash of
    the trimmed lower-case line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("r"), "text")
    rows = rows.select("doc_id", "t", "r", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    trimmed = rows.select("doc_id", "t", "r", "line_no", F.lower(F.trim("line")).alias("line")).where(F.col("line").rlike(MARK))
    return trimmed.withColumn("h", F.xxhash64("line"))


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, t, r, line_no, line_id, component, kept) of every line."""
    rows = cut(_lines(docs), "lines", "zstd")
    nodes = cut(rows.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "r")).alias("at")), "nodes")
    signed = cut(banded(signatures(hashed(rows.select("h", "line")))), "signed")
    members = shared_keys(signed, "keys")

    drop(signed)

    def items_of(ids: DataFrame) -> DataFrame:
        # so many passes that each one's ids fit a Bloom filter, and few lines are shuffled at a time
        passes, out = ids.count() // (3 * SIEVE_WORDS) + 1, None
        for k in range(passes):
            these, some = (x.where(F.pmod(c, F.lit(passes)) == k) for x, c in ((ids, "id"), (rows.select("h", "line"), "h")))
            may = sieve(these, these.count())
            some = some if may is None else may(some, F.col("h")).where("_hit").drop("_hit")
            some = some.join(these.select(F.col("id").alias("h")), "h", "left_semi")
            one = some.groupBy("h").agg(F.first("line").alias("item"))
            one = one.select(F.col("h").alias("id"), F.lit(None).cast("long").alias("n"), "item")  # the sizes would cost as much as the pairs
            one = one if passes == 1 else cut(one, "part")
            out = one if out is None else out.unionByName(one)
        return out

    owner = group(members, items_of, shingles, percent, SKETCH, elements, WORDS)
    named = nodes.join(owner.select(F.col("id").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    best = named.groupBy("component").agg(F.min("at").alias("best"))
    named = cut(named.join(best, "component").select("h", "component", "best"), "named")
    out = rows.select("doc_id", "t", "r", "line_no", "h").join(named, "h")
    drop(members, nodes)
    kept = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("line_no") == F.col("best.line_no")) & (F.col("r") == F.col("best.r"))
    return out.select("doc_id", "t", "r", "line_no", F.col("h").alias("line_id"), "component", kept.alias("kept"))


def decisions(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, line_no, line_id, component, kept) of every line of docs (doc_id, text) that isn't blank.

    Lines are what line breaks part, numbered from 0, compared trimmed and in lower case. line_id is a 64-bit hash of
    that form, the same for equal lines; lines are linked where the Jaccard similarity of their whole sets of character
    shingles is percent or more, and component is the smallest line_id that links reach. Of a component, the one
    line with the smallest (doc_id, line_no) is kept, and where rows repeat a doc_id with that line in the same place, that of one row.
    Blank lines have no row here and stay. Null and empty texts have no lines; rows with a null doc_id are left alone; rows that
    repeat a doc_id have a row for each of their lines. Other columns are ignored; an empty table gives an empty result.

    Equal lines are one node from the start, by partial aggregation, so a line in a third of all documents
    costs a row a task. Lines are written once; only those that share a band are shuffled.
    """
    return _decided(docs, percent).select("doc_id", "line_no", "line_id", "component", "kept")


def clean(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the lines that decisions() doesn't keep, all columns, n_chars made anew where there is one. A document
    all of whose lines go, or all but blank ones, goes itself; one that had no text, or blank lines only, stays as it is. Rows are told apart by
    doc_id and text; of rows that repeat both, which share all their lines, one stays."""
    every = cut(_decided(docs, percent).select("doc_id", "t", "r", "line_no", "kept"), "decided")
    first = every.groupBy("doc_id", "t").agg(F.min("r").alias("r"), F.max("r").alias("last"))
    twins = first.where("r < last").select("doc_id", "t")
    gone = every.where("not kept").groupBy("doc_id", "t", "r").agg(F.collect_set("line_no").alias("_gone")).join(first, ["doc_id", "t", "r"], "left_semi")
    gone = gone.join(twins.withColumn("_twin", F.lit(True)), ["doc_id", "t"], "full")
    gone = cut(gone.select(F.xxhash64("doc_id", "t").alias("_key"), "_gone", F.coalesce("_twin", F.lit(False)).alias("_twin")), "gone")
    may = sieve(gone.select("_key"), gone.count())
    # the rows in one column, so no name of theirs is in the way
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    rows = docs.select(key.alias("_id"), F.struct("*").alias("_row"))
    flagged = rows.withColumn("_hit", F.lit(True)) if may is None else may(rows, F.col("_id"))
    rest, some = flagged.where("not _hit").select("_row"), flagged.where("_hit")
    old = F.col("_row.text").cast("string")
    kept = F.filter(F.transform(F.split(old, "\n", -1), lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    hit = some.join(gone, F.col("_id") == F.col("_key"), "left")
    hit = hit.where("not coalesce(_twin, false)").unionByName(hit.where("_twin").dropDuplicates(["_id"]))
    hit = hit.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    hit = hit.where(F.col("_kept").isNull() | F.exists("_kept", lambda x: x.rlike(MARK))).withColumn("_text", F.array_join("_kept", "\n"))
    new = []
    for c in docs.columns:
        own = F.col("_row").getField(c)
        if c == "text":
            own = F.coalesce("_text", own)
        elif c == "n_chars":
            own = F.when(F.col("_text").isNotNull(), F.length("_text")).otherwise(own)
        new.append(own.cast(docs.schema[c].dataType).alias(c))
    return hit.select(*new).unionByName(rest.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))
