"""Document quality by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, drop

#: Hash buckets of each view's features.
TEXT, META = 1 << 14, 1 << 10
#: At most so many labelled rows are used, the smallest by a hash of their id; a fifth of them calibrates.
SAMPLE = 30_000
#: Rounds of exchange, and how right the pseudo-labels must be on the calibrating documents.
ROUNDS, PRECISION = 2, 0.97


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each document: of its text, the words, their last two bytes and marks of its style; of its page,
    language, source and the size that the page states, alone and together. Neither view sees the other's."""
    for batch in batches:
        for i, j, data, offsets in T.slices(batch.column("text")):
            part = batch.slice(i, j - i)
            w = T.Words(data, offsets, T.SPACE, suffix=2)
            a = (w.h % np.uint64(TEXT // 2)).astype(np.uint16)
            b = (w.suffix % np.uint64(TEXT // 2)).astype(np.uint16) + np.uint16(TEXT // 2)
            upper = np.add.reduceat(np.append((data >= 65) & (data <= 90), False).astype(np.int64), np.minimum(offsets[:-1], len(data)))
            lines = np.add.reduceat(np.append(data == 10, False).astype(np.int64), np.minimum(offsets[:-1], len(data)))
            lines[offsets[:-1] == offsets[1:]] = 0
            size = np.diff(offsets)
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            sizes = [len(bin(max(x or 0, 0))) for x in part.column("n_chars").to_pylist()]
            metas = [(f"lang={x}", f"source={y}", f"chars={z}", f"lang={x} source={y}") for x, y, z in zip(langs, sources, sizes)]
            t = []
            for x, y, up, n, br in zip(w.at, w.at[1:], upper, size, lines):
                kinds = len(np.unique(w.h[x:y]))
                # how often words repeat and how much is in capitals, in tenths, and how long lines and words are, beside the words themselves
                k = max(int(y - x), 1)
                style = [f"repeat={10 * kinds // k}", f"capitals={10 * int(up) // max(int(n), 1)}", f"lines={int(br).bit_length()}", f"line={(int(y - x) // (int(br) + 1)).bit_length()}", f"word={min(int(n) // k, 30)}"]
                t.append(np.unique(np.concatenate([a[x:y], b[x:y], np.array([_style(m) for m in style], np.uint16)])).tobytes())
            m = [np.unique(np.array([_bucket(x) for x in row], np.uint16)).tobytes() for row in metas]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "t", "m"])


def _style(x: str) -> int:
    return TEXT // 2 + zlib.crc32(x.encode()) % (TEXT // 2)


def _bucket(x: str) -> int:
    return zlib.crc32(x.encode()) % META


class View:
    """Bernoulli-like log-odds of each bucket from counts of documents."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        n = docs + 2
        with np.errstate(all="ignore"):
            self.odds = np.log((counts[1] + 1) / n[1]) - np.log((counts[0] + 1) / n[0])
        seen = counts.sum(0) >= 3
        self.odds = np.where(seen, np.clip(self.odds, -6, 6), 0.0)
        self.prior = float(np.log(n[1] / n[0]))

    def say(self, buckets: list[bytes]) -> np.ndarray:
        return np.array([self.prior + self.odds[np.frombuffer(b, np.uint16)].sum() for b in buckets])


def _limits(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """From which value on pseudo-labels of class 1, and up to which of class 0, are right often enough; infinite if none are."""
    out = []
    for sign, k in ((1, 1), (-1, 0)):
        order = np.argsort(-sign * z, kind="stable")
        right = np.cumsum(y[order] == k) / np.arange(1, len(z) + 1)
        ok = np.flatnonzero((right >= PRECISION) & (np.arange(len(z)) >= 9))
        out.append(float(z[order[ok[-1]]]) if len(ok) else sign * np.inf)
    return out[0], out[1]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small penalty, by Newton's method; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_score, meta_score, score, predicted) for each row of docs (doc_id, text, lang, source, n_chars).

    score is the calibrated probability of good quality from both views, text_score and meta_score from one; predicted is 1
    from 0.5 on. Null and empty texts, and nulls in lang, source and n_chars, are features like others. Rows with a null
    id are scored and never labelled; contradicting labels are 0; repeated rows are scored alike; other columns are ignored. Without labels of both
    classes every score is the share of the class there is, or 0.5. An empty table gives an empty result.

    One scan makes the features, which a table keeps. SAMPLE labelled rows at most are used, of which a fifth calibrates; in each round
    both views judge all other rows, and what one is sure of counts for the other. Only sums by bucket, of a fixed number,
    and the calibrating rows reach the driver; nothing but those sums is shuffled.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")), F.col("n_chars").cast("long").alias("n_chars"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    marks = cut(marks.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "marks")
    made = base.mapInArrow(_features, "doc_id long, t binary, m binary")
    made = cut(made.join(F.broadcast(marks), "doc_id", "left").withColumn("check", F.crc32(F.concat(F.lit("check"), F.col("doc_id").cast("string"))) % 5 == 0), "features")
    known = made.where("y is not null")
    fit = _sums(known.where("not check"), None)
    rows = known.where("check").orderBy("doc_id", "t", "m").select("t", "m", "y").collect()
    y = np.array([r.y for r in rows], float)
    docs_n = fit[2]
    if min(docs_n) < 1 or len(rows) < 10 or len(set(y)) < 2:
        total = docs_n.sum() + len(y)
        p = float((docs_n[1] + y.sum()) / total) if total else 0.5
        return made.select("doc_id", *(F.lit(p).alias(c) for c in ("text_score", "meta_score", "score")), F.lit(int(p >= 0.5)).alias("predicted"))
    ct, cm = [r.t for r in rows], [r.m for r in rows]
    text, meta = View(fit[0], docs_n), View(fit[1], docs_n)
    rest = made.where("y is null")
    for _ in range(rounds):
        judge = (text, meta, _limits(text.say(ct), y), _limits(meta.say(cm), y))
        more = _sums(rest, docs.sparkSession.sparkContext.broadcast(judge))
        # what the metadata view is sure of counts for the text view, and the other way round
        text = View(fit[0] + more[0], docs_n + more[2])
        meta = View(fit[1] + more[1], docs_n + more[3])
    zt, zm = text.say(ct), meta.say(cm)
    final = docs.sparkSession.sparkContext.broadcast((text, meta, _logistic(zt[:, None], y), _logistic(zm[:, None], y), _logistic(np.column_stack([zt, zm]), y)))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, wa, wb, w = final.value
        for batch in batches:
            x, z = a.say(batch.column("t").to_pylist()), b.say(batch.column("m").to_pylist())
            say = [1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (wa[0] * x + wa[1], wb[0] * z + wb[1], w[0] * x + w[1] * z + w[2])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, say)], ["doc_id", "text_score", "meta_score", "score"])

    out = made.mapInArrow(f, "doc_id long, text_score double, meta_score double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _sums(rows: DataFrame, judge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents by class and bucket of the text view and of the metadata view, and documents by class of each.

    judge None: rows have labels y. Else: rows the metadata view is sure of count for the text view, and those
    that the text view is sure of for the metadata view."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m, nt, nm = np.zeros((2, TEXT)), np.zeros((2, META)), np.zeros(2), np.zeros(2)
        for batch in batches:
            bt, bm = batch.column("t").to_pylist(), batch.column("m").to_pylist()
            if judge is None:
                by_text = by_meta = np.array(batch.column("y").to_pylist(), int)
            else:
                a, b, la, lb = judge.value
                za, zb = a.say(bt), b.say(bm)
                by_text = np.where(za >= la[0], 1, np.where(za <= la[1], 0, -1))
                by_meta = np.where(zb >= lb[0], 1, np.where(zb <= lb[1], 0, -1))
            for x, k in zip(bt, by_meta):
                if k >= 0:
                    t[k, np.frombuffer(x, np.uint16)] += 1
                    nt[k] += 1
            for x, k in zip(bm, by_text):
                if k >= 0:
                    m[k, np.frombuffer(x, np.uint16)] += 1
                    nm[k] += 1
        for view, c in ((0, t), (1, m), (2, nt[:, None]), (3, nm[:, None])):
            k, b = np.nonzero(c)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), view, np.int32)), pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c[k, b])], ["view", "k", "b", "n"])

    cols = ["t", "m"] + (["y"] if judge is None else [])
    out = rows.select(*cols).mapInArrow(f, "view int, k int, b int, n double").groupBy("view", "k", "b").agg(F.sum("n").alias("n")).collect()
    sums = [np.zeros((2, TEXT)), np.zeros((2, META)), np.zeros((2, 1)), np.zeros((2, 1))]
    for v, k, b, n in out:
        sums[v][k, b] = n
    return sums[0], sums[1], sums[2][:, 0], sums[3][:, 0]
