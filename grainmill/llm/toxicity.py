"""A convolutional text classifier of toxicity, trained in numpy by rounds over all labelled rows, on the executors."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, drop, fresh, sieve

#: Hash buckets of words and of their first PREFIX bytes (two bytes each), dimensions, filters of each width.
BUCKETS, PREFIX, DIM, FILTERS, WIDTHS = 1 << 16, 4, 12, 12, (1, 2, 3)
#: Words seen in fewer of the documents that are fitted on have no vector: they can't be told from noise.
SEEN = 3
BATCH, RATE = 32, 0.1
#: A small batch ends after so many words, too; a longer text is one of its own.
BATCH_WORDS = 1 << 17
#: Parts of the labelled rows and passes over them: with fewer rows than SMALL, and with more.
SMALL, FOLDS, EPOCHS = 10_000, (5, 3), (12, 6)
#: A round has a task for each model and so many rows, and WORKERS tasks for a model at most, which read the more rows.
ROWS, WORKERS = 8192, 128
#: Ranges of buckets in which tasks' changes are summed up.
BLOCKS = 32
#: What the network says is counted in steps of 1 / STEP up to REACH for calibration and thresholds.
STEP, REACH = 256, 60
#: predicted is 1 from this score on.
CUT = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of fitting; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of their beginnings, and where each text's begin."""
    w = T.Words(data, offsets, T.PUNCT, prefix=PREFIX)
    return (w.h % np.uint64(BUCKETS)).astype(np.int32), (w.prefix % np.uint64(BUCKETS)).astype(np.int32), w.at


class Model:
    """Embeddings of words and beginnings, filters of several widths, max pooling, a logistic layer; then a calibration."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.word = (r.normal(0, 0.05, (BUCKETS + 1, DIM))).astype(f32)
        self.start = (r.normal(0, 0.05, (BUCKETS + 1, DIM))).astype(f32)
        self.filters = [(r.normal(0, 0.3, (w, DIM, FILTERS))).astype(f32) for w in WIDTHS]
        for x in self.filters:
            x[0, 0, 0] = 1.0
        self.shift = np.zeros((len(WIDTHS), FILTERS), f32)
        self.out = (r.normal(0, 0.1, len(WIDTHS) * FILTERS)).astype(f32)
        self.bias = np.zeros((), f32)
        self.scale, self.base = 1.0, 0.0
        self.constant: float | None = None
        #: While fitting: the words of each table that have a vector, and the squares of all steps' gradients.
        self.seen: list[np.ndarray] = []
        self.caches: list[np.ndarray] = []

    def _padded(self, words, starts, at):
        """The words with so many empty ones after each text, whose vectors are zero, as the widest filter looks at, so that none
        looks into the next text, and each text's place."""
        n, pad = np.diff(at), max(WIDTHS)
        to = at[:-1] + pad * np.arange(len(n))
        w = np.full(len(words) + pad * len(n), BUCKETS, np.int32)
        s = w.copy()
        place = np.arange(len(words)) + pad * np.repeat(np.arange(len(n)), n)
        w[place], s[place] = words, starts
        return w, s, to, to + np.maximum(n, 1)

    def _maps(self, w, s):
        x = self.word[w] + self.start[s]
        maps = []
        for f, b in zip(self.filters, self.shift):
            k = len(f)
            m = x[: len(x) - k + 1] @ f[0]
            for j in range(1, k):
                m += x[j : len(x) - k + 1 + j] @ f[j]
            maps.append(m + b)
        return x, maps

    def raw(self, words, starts, at) -> np.ndarray:
        """What the network says of each text, before the calibration."""
        if len(at) < 2:
            return np.zeros(0)
        w, s, a, z = self._padded(words, starts, at)
        _, maps = self._maps(w, s)
        ends = np.stack([a, z], 1).ravel()
        pooled = np.concatenate([np.maximum.reduceat(np.vstack([m, np.full((3, FILTERS), -1e9, np.float32)]), ends)[::2] for m in maps], 1)
        return np.maximum(pooled, 0) @ self.out + self.bias

    def score(self, words, starts, at) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return self.calibrated(self.raw(words, starts, at).astype(np.float64))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.base, -40, 40)))

    def begin(self, count: np.ndarray, n: np.ndarray) -> None:
        """Vectors begin at the class log-odds of what is seen often enough, and at zero for the rest. count: how many of the n documents of each
        class have each bucket, by class and table."""
        n = np.maximum(n, 1)
        self.seen = []
        for which, table in enumerate(self.tables()):
            c = count[:, which].astype(float)
            odds = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
            seen = c.sum(0) >= SEEN
            table[:, 0] = np.clip(odds, -3, 3) / 2
            table[~seen] = 0
            table[BUCKETS] = 0
            self.seen.append(seen & (np.arange(BUCKETS + 1) < BUCKETS))
        self.caches = [np.full_like(x, 1e-2) for x in (*self.tables(), *self.dense())]

    def __getstate__(self) -> dict:
        """Without the rows of words that have no vector, of which there are most, so little is sent."""
        state = dict(self.__dict__)
        sent = state["sent"] = []
        for k, name in enumerate(("word", "start")):
            table = state.pop(name)
            at = np.flatnonzero(table.any(1) | (self.seen[k] if self.seen else False))
            sent.append((at.astype(np.int32), table[at], self.caches[k][at] if self.caches else None))
        state["caches"] = self.caches[2:]
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        tables, caches = [], []
        for at, rows, cache in self.__dict__.pop("sent"):
            tables.append(np.zeros((BUCKETS + 1, DIM), np.float32))
            tables[-1][at] = rows
            if cache is not None:
                caches.append(np.full((BUCKETS + 1, DIM), 1e-2, np.float32))
                caches[-1][at] = cache
        self.word, self.start = tables
        self.caches = [*caches, *self.caches]

    def tables(self) -> list[np.ndarray]:
        return [self.word, self.start]

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.shift, self.out, self.bias]

    def step(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, r: np.random.Generator, touched: list[np.ndarray]) -> None:
        """One step of Adagrad on a small batch; marks in touched the rows of the tables that it moves."""
        words = np.concatenate([d[0] for d in docs])
        starts = np.concatenate([d[1] for d in docs])
        at = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
        w, s, a, z = self._padded(words, starts, at)
        x, maps = self._maps(w, s)
        where = [np.stack([p + m[p:q].argmax(0) for p, q in zip(a, z)]) for m in maps]
        pooled = np.concatenate([np.take_along_axis(m, p, 0) for m, p in zip(maps, where)], 1)
        keep = (r.random(pooled.shape) > 0.2) / 0.8
        act = np.maximum(pooled, 0) * keep
        prob = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias, -30, 30)))
        g = ((prob - y) / len(docs)).astype(np.float32)
        dpool = (g[:, None] * self.out) * keep * (pooled > 0)
        at, grad, dfs, dshift = [], [], [], np.zeros_like(self.shift)
        for j, f in enumerate(self.filters):
            d = dpool[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
            dshift[j] = d.sum(0)
            df = np.zeros_like(f)
            for k in range(len(f)):
                pos = where[j] + k
                df[k] = np.einsum("bfd,bf->df", x[pos], d)
                at.append(pos.ravel())
                grad.append((d[:, :, None] * f[k].T[None]).reshape(-1, DIM))
            dfs.append(df)
        pos, grad = np.concatenate(at), np.concatenate(grad)
        for table, c, rows, seen, mark in zip(self.tables(), self.caches, (w[pos], s[pos]), self.seen, touched):
            u, inv = np.unique(rows, return_inverse=True)
            total = np.zeros((len(u), DIM), np.float32)
            np.add.at(total, inv, grad)
            u, total = u[seen[u]], total[seen[u]]
            mark[u] = True
            c[u] += total**2
            table[u] -= RATE * total / np.sqrt(c[u])
        for v, c, d in zip(self.dense(), self.caches[2:], (*dfs, dshift, act.T @ g, g.sum())):
            c += d**2
            v -= (RATE * d / np.sqrt(c)).astype(np.float32)

    def calibrate(self, z: np.ndarray, n: np.ndarray) -> None:
        """A logistic curve over what networks say of texts that they weren't fitted on: n texts of each class at each z. As if the classes'
        ratio were the root of what it is among the labels, which says little about a corpus."""
        both = n.sum(0)
        y = np.repeat([0, 1], len(z))
        weight = np.concatenate([n[:, k] * np.sqrt(both.sum() / 2 / both[k]) for k in (0, 1)])
        z = np.concatenate([z, z])
        size = max(float((np.abs(z) * np.concatenate([n[:, 0], n[:, 1]])).sum() / both.sum()), 1e-6)
        x = np.column_stack([z / size, np.ones(len(z))])
        target = np.where(y == 1, 1 - 1 / (2 + both[1]), 1 / (2 + both[0]))
        w = np.array([1.0, 0.0])

        def loss(w: np.ndarray) -> float:
            v = x @ w
            return float((weight * (np.logaddexp(0, v) - target * v)).sum()) + 5e-3 * float(w @ w)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (weight * (p - target)) + 1e-2 * w
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            step, part = np.linalg.solve(hess, grad), 1.0
            while part > 1e-6 and loss(w - part * step) > loss(w):
                part /= 2
            w = w - part * step
            if np.abs(part * step).max() < 1e-8:
                break
        a, b = w[0] / size, w[1]
        self.scale, self.base = float(max(a, 1e-3)), float(b)


def threshold(score: np.ndarray, n: np.ndarray) -> float:
    """The score that parts the classes best (F1; the middle of the best range), of n texts of each class at each of rising scores; CUT, where a class has
    fewer than ten."""
    if (n.sum(0) < 10).any():
        return CUT
    tp, fp = np.cumsum(n[::-1, 1]), np.cumsum(n[::-1, 0])
    f1 = 2 * tp / (tp + fp + n[:, 1].sum())
    k = len(score) - 1 - int(f1.argmax())
    return float(min(max((score[k] + (score[k - 1] if k else 0)) / 2, 0.05), 0.95))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in T.slices(batch.column("text")):
            w, s, at = hashed(data, offsets)
            cells = []
            for x in (w, s):
                x = x.astype(np.uint16)
                cells.append(pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *cells], ["doc_id", "lang", "w", "s"])


def _docs(batch: pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The words and beginnings of each document, and its label."""
    cells = ([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(c)] for c in ("w", "s"))
    return list(zip(*cells)), batch.column("toxic").to_numpy(zero_copy_only=False)


def _batches(docs: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray) -> Iterator[list[int]]:
    pick, words = [], 0
    for k in order:
        if pick and (len(pick) == BATCH or words + len(docs[k][0]) > BATCH_WORDS):
            yield pick
            pick, words = [], 0
        pick.append(k)
        words += len(docs[k][0])
    if pick:
        yield pick


_CHANGE = "model int, block int, part int, payload binary"
_EDGES = np.linspace(0, BUCKETS + 1, BLOCKS + 1).astype(int)


def _rows(model: int, part: int, payloads: dict[int, list]) -> pa.RecordBatch:
    n = len(payloads)
    return pa.RecordBatch.from_arrays(
        [pa.array([model] * n, pa.int32()), pa.array(list(payloads), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([pickle.dumps(x) for x in payloads.values()], pa.binary())],
        ["model", "block", "part", "payload"],
    )


def _summed(table: pa.Table) -> pa.Table:
    """Of payloads, lists of (places, values…), the sums by place, in the order of parts."""
    got = [pickle.loads(x) for x in table.sort_by("part").column("payload").to_pylist()]
    out = []
    for same in zip(*got):
        u, inv = np.unique(np.concatenate([x[0] for x in same]), return_inverse=True)
        sums = []
        for values in list(zip(*same))[1:]:
            v = np.concatenate(values)
            total = np.zeros((len(u), *v.shape[1:]), v.dtype)
            np.add.at(total, inv, v)
            sums.append(total)
        out.append((u, *sums))
    return pa.Table.from_batches([_rows(table.column("model")[0].as_py(), 0, {table.column("block")[0].as_py(): out})])


def _sums(changes: DataFrame) -> Iterator[tuple[int, int, list]]:
    for r in changes.groupBy("model", "block").applyInArrow(_summed, _CHANGE).toLocalIterator():
        yield r.model, r.block, pickle.loads(r.payload)


def _counted(folds: int):
    """In how many documents of each part and class each bucket is."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((folds, 2, 2, BUCKETS + 1), np.int64)
        for batch in batches:
            docs, y = _docs(batch)
            for d, label, fold in zip(docs, y, batch.column("fold").to_numpy()):
                for which in (0, 1):
                    count[fold, label, which, np.unique(d[which])] += 1
        for fold in range(folds):
            blocks = {}
            for b in range(BLOCKS):
                c = count[fold, :, :, _EDGES[b] : _EDGES[b + 1]].reshape(4, -1)
                at = np.flatnonzero(c.any(0))
                if len(at):
                    blocks[b] = [(at + _EDGES[b], c[:, at].T)]
            if blocks:
                yield _rows(fold, TaskContext.get().partitionId(), blocks)

    return f


def _pass(sent, epoch: int):
    """One pass of each task over its rows, from the models as sent; what it changes, in blocks. The last block is of the dense weights."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), {}
        r = np.random.default_rng([5, epoch, part])
        for batch in batches:
            which = batch.column("model").to_numpy()
            docs, y = _docs(batch)
            for k in np.unique(which).tolist():
                if k not in own:
                    own[k] = copy.deepcopy(sent.value[k]), [np.zeros(BUCKETS + 1, bool) for _ in range(2)]
                model, touched = own[k]
                for pick in _batches(docs, r.permutation(np.flatnonzero(which == k))):
                    model.step([docs[i] for i in pick], y[pick], r, touched)
        for k, (model, touched) in own.items():
            old, blocks = sent.value[k], {}
            for b in range(BLOCKS):
                blocks[b] = []
                for j, mark in enumerate(touched):
                    at = np.flatnonzero(mark[_EDGES[b] : _EDGES[b + 1]]) + _EDGES[b]
                    blocks[b].append((at, model.tables()[j][at] - old.tables()[j][at], model.caches[j][at] - old.caches[j][at], np.ones(len(at), np.float32)))
            flat = [np.concatenate([(new - was).ravel() for new, was in zip(x, z)]) for x, z in ((model.dense(), old.dense()), (model.caches[2:], old.caches[2:]))]
            blocks[BLOCKS] = [(np.arange(len(flat[0])), *flat, np.ones(len(flat[0]), np.float32))]
            yield _rows(k, part, blocks)

    return f


def _move(model: Model, block: int, sums: list) -> None:
    """Moves the weights by the mean change of the tasks that have changed them."""
    if block < BLOCKS:
        for k, (at, change, cache, n) in enumerate(sums):
            model.tables()[k][at] += change / n[:, None]
            model.caches[k][at] += cache / n[:, None]
        return
    ((_, change, cache, n),) = sums
    for arrays, flat in ((model.dense(), change / n), (model.caches[2:], cache / n)):
        for x, part in zip(arrays, np.split(flat, np.cumsum([x.size for x in arrays])[:-1])):
            x += part.reshape(x.shape)


def _judged(sent):
    """(lang, toxic, z) of rows: what the network that wasn't fitted on a row's part says of it, in steps."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, _ = _docs(batch)
            z = [sent.value[fold].raw(*d, np.array([0, len(d[0])]))[0] for d, fold in zip(docs, batch.column("fold").to_pylist())]
            steps = np.rint(np.clip(np.array(z, float), -REACH, REACH) * STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(steps)], ["lang", "toxic", "z"])

    return f


def _labelled(docs: DataFrame, marked: DataFrame, total: int, tasks: int) -> DataFrame:
    """(doc_id, lang, w, s, toxic) of all documents of marked, whatever their length, each text as two bytes a word and as many for its beginning."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    may = sieve(marked.select("doc_id"), total)
    some = base if may is None else may(base, F.col("doc_id")).where("_hit").select("doc_id", "lang", "text")
    words = some.where(~held_out(F.col("doc_id"))).mapInArrow(_buckets, "doc_id long, lang string, w binary, s binary")
    # in an order that says nothing, and the same in each run
    return cut(words.join(marked, "doc_id").repartition("doc_id").coalesce(tasks).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "w", "s"), "labelled", "zstd")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]]:
    """The model and the thresholds by language, from all labelled rows that aren't held out.

    A model goes over all of them in rounds. In each, every task makes one pass of small batches over its rows, from the same weights, and the weights move by
    the mean of what the tasks change. Calibration and thresholds are of all rows too: a network for each of FOLDS parts, fitted on the other parts, judges that part.
    A document with contradicting labels is toxic. With rows of one class only, or hardly any, the model is a constant.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = cut(marked.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "marked")
    total = {int(k): int(n) for k, n in marked.groupBy("toxic").count().collect()}
    model = Model()
    model.constant = total.get(1, 0) / max(sum(total.values()), 1)
    if len(total) < 2:
        drop(marked)
        return model, {"": CUT}
    tasks = min(WORKERS, -(-sum(total.values()) // ROWS))
    rows = _labelled(docs, marked, sum(total.values()), tasks)
    drop(marked)
    there = {int(k): int(n) for k, n in rows.groupBy("toxic").count().collect()}
    if sum(there.values()) < 20 or min(there.get(0, 0), there.get(1, 0)) < 4:
        drop(rows)
        return model, {"": CUT}
    large = sum(there.values()) >= SMALL
    folds = FOLDS[large]
    parted = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(folds)).cast("int"))
    n = np.zeros((folds, 2))
    for fold, toxic, k in parted.groupBy("fold", "toxic").count().collect():
        n[fold, toxic] = k
    count = np.zeros((folds, 2, 2, BUCKETS + 1), np.int64)
    for fold, _, ((at, c),) in _sums(parted.select("toxic", "fold", "w", "s").coalesce(tasks).mapInArrow(_counted(folds), _CHANGE)):
        count[fold][:, :, at] = c.T.reshape(2, 2, -1)
    # the last one is of all rows, the others of all but one part
    models = [Model() for _ in range(folds + 1)]
    for k, m in enumerate(models):
        others = np.arange(folds) != k
        m.begin(count[others].sum(0), n[others].sum(0))
    every = None
    for k in range(folds + 1):
        # coalesce(1) would have Spark put all models' rows in one partition
        own = parted.where(F.col("fold") != k).select("toxic", F.lit(k).alias("model"), "w", "s").coalesce(max(2, tasks))
        every = own if every is None else every.unionByName(own)
    for epoch in range(EPOCHS[large]):
        sent = spark.sparkContext.broadcast(models)
        moved = list(_sums(every.mapInArrow(_pass(sent, epoch), _CHANGE)))
        sent.destroy(blocking=True)
        for k, block, sums in moved:
            _move(models[k], block, sums)
    for m in models:
        m.caches, m.seen = [], []
    model = models.pop()
    sent = spark.sparkContext.broadcast(models)
    judged = parted.select("lang", "toxic", "fold", "w", "s").mapInArrow(_judged(sent), "lang string, toxic int, z int")
    steps = cut(judged.groupBy("lang", "z").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")), "judged")
    sent.destroy(blocking=True)

    def counts(of: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = of.groupBy("z").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("z").toArrow()
        return t["z"].to_numpy() / STEP, np.column_stack([t["n0"].to_numpy(), t["n1"].to_numpy()]).astype(float)

    z, of = counts(steps)
    model.constant = None
    model.calibrate(z, of)
    limits = {"": threshold(model.calibrated(z), of)}
    for r in steps.where("lang <> ''").groupBy("lang").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 >= 10 and n1 >= 10").orderBy("lang").collect():
        z, of = counts(steps.where(F.col("lang") == r.lang))
        limits[r.lang] = threshold(model.calibrated(z), of)
    drop(rows, steps)
    return model, limits


def _scored(sent):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                others = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(model.score(*hashed(data, offsets)))], [*others, "score"])

    return f


def _limit(limits: dict[str, float], lang: Column) -> Column:
    out = F.lit(limits[""])
    for k, v in sorted(limits.items()):
        if k:
            out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, toxic) for each row of docs (doc_id, text, lang).

    score, from 0 to 1, is made of the whole text and nothing else; a null or empty text is scored like a text without words. predicted is 1
    from CUT on; toxic is 1 from the threshold of the row's language on. Rows whose crc32(doc_id) mod 3 is 1 are held
    out of fitting; a null id isn't held out and never labelled. Repeated rows and nulls in lang are scored like others; other
    columns are ignored; an empty table gives an empty result. All labelled rows are fitted on, by the executors; scoring is one scan without a shuffle.
    """
    model, limits = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(_scored(sent), "doc_id long, lang string, score double")
    limit = _limit(limits, F.col("lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).cast("int").alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below their language's threshold, all columns, in one scan."""
    from pyspark.sql.types import StructType

    model, limits = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh("_score", docs)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(*hashed(data, offsets)))], [*part.schema.names, name])

    scored = docs.mapInArrow(f, StructType(list(docs.schema.fields)).add(name, "double"))
    return scored.where(F.col(name) < _limit(limits, F.col("lang"))).select(*docs.columns)
