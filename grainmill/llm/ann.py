"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: Codebooks of full dimension, words in each, beams kept while encoding.
CODEBOOKS, WORDS, BEAMS = 8, 256, 8
#: The codebooks are fitted on at most so many vectors, the smallest by a hash of their id.
SAMPLE = 8192
#: Queries that one pass over the codes answers; they are broadcast (at most 4096 x dimension x 8 bytes).
QUERY_BLOCK = 4096
#: Candidates of each query that a part of the index reranks exactly.
RERANK = 256
#: Rows of the index that are scored at once.
ROWS = 8192


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(x: np.ndarray, books: np.ndarray, beams: int = BEAMS) -> np.ndarray:
    """Codes (n, M) by beam search: after each codebook, the beams best sums of words so far are kept."""
    m, k, d = books.shape
    out = np.empty((len(x), m), np.uint8 if k <= 256 else np.uint16)
    norms = (books**2).sum(2)
    for at in range(0, len(x), 1024):
        r = x[at : at + 1024][:, None, :]
        n = len(r)
        codes = np.zeros((n, 1, 0), np.int64)
        cost = (r**2).sum(2)
        for j in range(m):
            # |residual - word|^2 for each beam and word
            c = cost[:, :, None] - 2 * (r @ books[j].T) + norms[j]
            b = c.shape[1]
            flat = c.reshape(n, b * k)
            keep = min(beams, b * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(flat, best, 1)
            beam, word = best // k, best % k
            r = np.take_along_axis(r, beam[:, :, None], 1) - books[j][word]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None]], 2)
        out[at : at + n] = np.take_along_axis(codes, cost.argmin(1)[:, None, None], 1)[:, 0]
    return out


def train(x: np.ndarray, m: int = CODEBOOKS, k: int = WORDS, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (M, K, d): residual k-means to begin with, then least squares over all of them for the codes of beam search."""
    r = np.random.default_rng(seed)
    n, d = x.shape
    k = min(k, max(1, n // 4))
    books, rest = np.zeros((m, k, d)), x.copy()
    for j in range(m):
        c = rest[r.choice(n, k, replace=n < k)]
        for _ in range(6):
            a = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
            sums = np.zeros((k, d))
            np.add.at(sums, a, rest)
            count = np.bincount(a, minlength=k)
            c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[r.choice(n, k)])
        books[j] = c
        rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
    for _ in range(rounds):
        codes = encode(x, books, 4).astype(np.int64) + np.arange(m) * k
        gram, right = np.zeros((m * k, m * k)), np.zeros((m * k, d))
        for a in range(m):
            np.add.at(right, codes[:, a], x)
            for b in range(m):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1.0)
        books = np.linalg.solve(gram + np.eye(m * k) * 0.05 * n / (m * k), right + 0.05 * n / (m * k) * books.reshape(m * k, d)).reshape(m, k, d)
    return books


def reconstruct(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def _indexed(books):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        for batch in batches:
            v = _matrix(batch.column("v"))
            if len(v):
                codes = encode(unit(v), b)
                norm = np.linalg.norm(reconstruct(codes, b), axis=1)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), packed, pa.array(norm)], ["vec_id", "v", "codes", "norm"])

    return f


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _searched(queries, books, k: int, rerank: int, row_block: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        b = books.value
        m, w, d = b.shape
        luts = np.einsum("qd,mkd->qmk", unit(q), b).astype(np.float32)
        qn = np.sqrt((q * q).sum(1))
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, row_block):
                part = batch.slice(at, row_block)
                vid = part.column("vec_id").to_numpy()
                order = np.argsort(vid, kind="stable")
                vid, v = vid[order], _matrix(part.column("v"))[order]
                code = part.column("codes")
                codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8 if w <= 256 else np.uint16).reshape(len(vid), m)[order].astype(np.int64)
                norm = part.column("norm").to_numpy()[order].astype(np.float32)
                vn = np.sqrt((v * v).sum(1))
                for i in range(len(ids)):
                    score = np.zeros(len(vid), np.float32)
                    for j in range(m):
                        score += luts[i, j][codes[:, j]]
                    score /= np.maximum(norm, 1e-12)
                    score[vid == ids[i]] = -np.inf
                    if len(score) > rerank:
                        bound = np.partition(score, len(score) - rerank)[len(score) - rerank]
                        above = np.flatnonzero(score > bound)
                        some = np.concatenate([above, np.flatnonzero(score == bound)[: rerank - len(above)]])
                        some.sort()
                    else:
                        some = np.arange(len(score))
                    some = some[vid[some] != ids[i]]
                    exact = (v[some] * q[i]).sum(1) / (vn[some] * qn[i])
                    a = np.concatenate([top[i][0], vid[some]])
                    s = np.concatenate([top[i][1], exact])
                    keep = np.lexsort((a, -s))[:k]
                    top[i] = (a[keep], s[keep])
        n = [len(x) for x, _ in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x for x, _ in top])), pa.array(np.concatenate([s for _, s in top]))],
                ["query_id", "vec_id", "score"],
            )

    return f


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: v in double precision, without null or non-finite components, not zero, of the
    commonest length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return out.where(~bad).where(F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, k: int = 5, every: int = 50, codebooks: int = CODEBOOKS, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose vec_id is divisible by every, against all other rows of vectors (vec_id, embedding).

    score is the cosine of the original vectors in double precision; nearest first, ties to the smaller vec_id; all candidates where there are
    fewer than k. Rows whose vector is null, empty, zero, or holds a null or non-finite component take no part, nor
    does a null vec_id or a vector of another length than most. Repeated vec_ids are candidates each, and no candidate of their own
    id; of rows that repeat a query's id the least vector, component by component, asks. Other columns are ignored; an empty table gives an empty result.

    Codebooks are fitted on at most SAMPLE vectors. Every row is encoded and its
    reconstruction's norm stored. Queries go over all codes in blocks of QUERY_BLOCK, each broadcast: tables of inner products score
    the codes, each block of an index part reranks its best exactly, and only k rows a query and part are merged. As the queries are a
    share of all rows, the work grows with the square of the table; every query sees every code.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size.d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    books = train(unit(np.array([r.v for r in sample])), codebooks)
    sent = spark.sparkContext.broadcast(books)
    index = cut(rows.mapInArrow(_indexed(sent), "vec_id long, v array<double>, codes binary, norm double"), "index")
    asked = cut(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    n = asked.count()
    blocks = max(1, -(-n // (QUERY_BLOCK // 2)))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if not part:
            continue
        q = spark.sparkContext.broadcast((np.array([r.vec_id for r in part], np.int64), np.array([r.v for r in part])))
        one = index.mapInArrow(_searched(q, sent, k, rerank, ROWS), "query_id long, vec_id long, score double")
        one = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        one = cut(one.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
        found = one if found is None else found.unionByName(one)
    drop(index, asked)
    return spark.createDataFrame([], schema) if found is None else found
