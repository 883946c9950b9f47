"""MinHash near-duplicate documents by min-max hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, drop, sieve
from .links import FIELDS, group, shared_keys

#: 75 permutations give 150 values, 30 bands of 5: a pair at similarity 0.8 is missed by all bands once in 150,000 times.
PERMUTATIONS, BANDS, ROWS = 75, 30, 5


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(1, 1 << 63, k, dtype=np.uint64) * 2 + 1, r.integers(0, 1 << 63, k, dtype=np.uint64)


def min_max(h: np.ndarray, at: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Min-max signatures of the sets h[at[i]:at[i + 1]] (none empty): the minimum and the maximum under
    each permutation, so that each hash evaluation gives two values, each equal for two sets
    with the probability of their Jaccard similarity."""
    a, b = _permutations(permutations)
    out = np.empty((len(at) - 1, 2 * permutations), np.uint64)
    for j in range(permutations):
        x = h * a[j] + b[j]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, j] = np.minimum.reduceat(x, at[:-1])
        out[:, permutations + j] = np.maximum.reduceat(x, at[:-1])
    return out


def _digests(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:])]


def _signed(shingle_words: int, bands: int, rows: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("text")):
                h, at = T.shingle_sets(T.Words(data, offsets, T.SPACE), shingle_words)
                n = np.diff(at)
                digest = _digests(h, at)
                keys, sketch = np.zeros((j - i, bands), np.uint64), np.zeros(j - i, np.uint64)
                some = n > 0
                if some.any():
                    sig = min_max(h, np.append(at[:-1][some], at[-1]), bands * rows // 2)
                    x = np.full((len(sig), bands), 1, np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        x = T.mix(x * np.uint64(31) + sig[:, r::rows])
                    keys[some] = x
                    for r in range(FIELDS):
                        sketch[some] |= (T.mix(sig[:, r]) >> np.uint64(61)) << np.uint64(3 * r)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(sketch.view(np.int64))], ["doc_id", "t", "n_shingles", "digest", "bands", "sk"])

    return f


def _sets(shingle_words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("text")):
                h, at = T.shingle_sets(T.Words(data, offsets, T.SPACE), shingle_words)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_digests(h, at), pa.binary()), lists], ["digest", "s"])

    return f


def _grouped(docs: DataFrame, shingle_words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, chosen) of docs (doc_id, text): t is a hash of the text, chosen marks the row of a group with
    the smallest (doc_id, t), and every row without shingles or id.

    A node is a set of shingles, whatever rows and ids have it, so copies are never paired and rows that repeat an id aren't mixed up."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_signed(shingle_words, bands, rows), "doc_id long, t long, n_shingles long, digest binary, bands array<long>, sk long"), "signed")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    node = F.xxhash64("digest").alias("id")
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.first("bands").alias("bands"), F.first("sk").alias("sk"))
    classes = cut(classes.select("digest", node, "at", "bands", "sk"), "classes")
    members = shared_keys(classes, "bands")

    def items_of(ids: DataFrame) -> DataFrame:
        wanted = classes.select("id", F.col("at.doc_id").alias("doc_id")).join(ids, "id", "left_semi").select("doc_id").distinct()
        may = sieve(wanted, ids.count())
        some = docs if may is None else may(docs, F.col("doc_id")).where("_hit").drop("_hit")
        some = some.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "digest binary, s array<long>")
        return some.select(node, F.size("s").cast("long").alias("n"), F.col("s").alias("item")).join(ids, "id", "left_semi").dropDuplicates(["id"])

    owner = group(members, items_of, lambda s: s, percent)
    named = classes.select("digest", "id", "at").join(owner, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = named.groupBy("component").agg(F.min("at").alias("best"))
    named = cut(named.join(best, "component").select("digest", "best"), "named")
    own = F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("digest")).alias("digest")
    out = signed.select("doc_id", "t", "n_shingles", own).join(named, "digest", "left")
    drop(members, classes)
    chosen = F.coalesce((F.col("doc_id") == F.col("best.doc_id")) & (F.col("t") == F.col("best.t")), F.lit(True))
    return out.select("doc_id", "t", "n_shingles", F.coalesce("best.doc_id", "doc_id").alias("component_id"), chosen.alias("chosen"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Words are what the space and the bytes 9 to 13 separate, A-Z lower-cased, of the whole text;
    a shingle is so many following words, or the whole sequence where there are fewer.
    Documents are linked at a Jaccard similarity of percent or more of their whole sets
    (compared as 64-bit hashes of whole shingles); component_id is the smallest doc_id that
    links reach. Equal sets are one node, whatever their number, so copies are never paired.
    A null or empty text, or one without words, has n_shingles 0 and its own component. A null
    doc_id has a null component and is kept. Rows that repeat a doc_id are judged by their own texts; kept tells whether doc_id is
    component_id, for each of them. Other columns are ignored. An empty table gives an empty result.
    """
    out = _grouped(docs, shingle_words, percent, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each group of near_duplicates(), all columns: the one with the smallest doc_id, and one of rows that repeat that id
    and text. Rows with a null doc_id or without words all stay.

    Rows are told apart by a hash of id and text. Where the hashes to drop fit a bounded Bloom filter, only rows that it
    hits are shuffled."""
    every = _grouped(docs, shingle_words, percent, BANDS, ROWS).where("n_shingles > 0 and doc_id is not null")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    gone = every.groupBy(F.xxhash64("doc_id", "t").alias("k")).agg(F.max("chosen").alias("_twin"), F.count(F.lit(1)).alias("n")).where("not _twin or n > 1")
    gone = cut(gone.select("k", "_twin"), "gone")
    may = sieve(gone.select("k"), gone.count())
    # the rows in one column, so no name of theirs is in the way
    rows = docs.select(F.when(F.col("doc_id").isNotNull(), key).alias("_key"), F.struct("*").alias("_row"))
    flagged = rows.withColumn("_hit", F.lit(True)) if may is None else may(rows, F.col("_key"))
    some = flagged.where("_hit").join(gone, F.col("_key") == F.col("k"), "left")
    left = some.where("_twin is null").select("_row").unionByName(some.where("_twin").dropDuplicates(["_key"]).select("_row"))
    return flagged.where("not _hit").select("_row").unionByName(left).select("_row.*")
