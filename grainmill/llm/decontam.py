"""Benchmark decontamination: pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: One edit in so many characters of an item is allowed.
CHARS_PER_EDIT = 20
#: Items in one automaton, and their characters (about 25 MB in a worker); a larger benchmark is matched block by block.
BLOCK, CHARS = 5_000, 2_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case; every run of other characters than letters and digits is one space; none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of nearly equal length, with their places: if a passage is
    within that many edits of the item, one piece at least stands in it unchanged."""
    n = edits + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of a pattern of m characters to any passage of text, and where that
    ends; (most + 1, -1) if none is within most. A column of the dynamic programme is two m-bit integers."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a passage may begin anywhere
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = {i: (t, budget(t), masks(t)) for i, t in items}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (t, e, _) in self.items.items():
            for at, p in pieces(t, e):
                places.setdefault(p, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for p, v in places.items():
            self.automaton.add_word(p, (len(p), v))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Of each item that a passage of text is close enough to: the least distance, and where that ends in the normal form."""
        text = normal(text)
        spans: dict[int, list[list[int]]] = {}
        for end, (n, v) in self.automaton.iter(text):
            for i, at in v:
                t, e, _ = self.items[i]
                a = max(0, end - n + 1 - at - e)
                b = min(len(text), end - n + 1 - at + len(t) + e)
                own = spans.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        out = {}
        for i, own in spans.items():
            t, e, peq = self.items[i]
            best, end = e + 1, -1
            for a, b in own:
                k = text.find(t, a, b)
                while k >= 0 and e == 0 and not self._whole(text, k, len(t)):
                    k = text.find(t, k + 1, b)
                if k < 0 and e == 0:
                    continue
                d, z = (0, k - a + len(t)) if k >= 0 else myers(peq, len(t), text[a:b], best - 1)
                if d < best:
                    best, end = d, a + z
                if best == 0:
                    break
            if best <= e:
                out[i] = (best, end)
        return out

    @staticmethod
    def _whole(text: str, at: int, n: int) -> bool:
        return (at == 0 or text[at - 1] == " ") and (at + n == len(text) or text[at + n] == " ")


_made: dict[str, Matcher] = {}


def _worker(sent) -> Matcher:
    """The matcher of a broadcast (key, items, ids). A worker is reused by tasks of other blocks and benchmarks, and a
    Broadcast's address in it by another Broadcast, so the key travels with the items."""
    key, items, _ = sent.value
    if key not in _made:
        if len(_made) > 1:
            _made.clear()
        _made[key] = Matcher(items)
    return _made[key]


def _blocks(benchmark: DataFrame, items: int, chars: int) -> Iterator[dict[str, list[int]]]:
    """The benchmark's items by normal form, at most so many of them, of so many characters, at a time (one at least)."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    part: dict[str, list[int]] = {}
    n = size = 0
    for r in bench.toLocalIterator():
        t = normal(r.text)
        if not t:
            continue
        if n and (n >= items or size + len(t) > chars):
            yield part
            part, n, size = {}, 0, 0
        part.setdefault(t, []).append(r.item_id)
        n, size = n + 1, size + len(t)
    if n:
        yield part


def _sent(spark, part: dict[str, list[int]]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, list(enumerate(part)), list(part.values())))


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, chars: int = CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_end) for every row of docs (doc_id, text) and item of benchmark (item_id, text) that a
    passage of the text is close to: at most one edit in CHARS_PER_EDIT characters, both in normal form.

    distance is the least edit distance of any passage that holds an unchanged piece in its place (within the budget), match_end where it ends in
    the text's normal form. Items of fewer characters than that allow no edits and match whole words. Empty and null items match
    nothing; empty and null texts hold nothing. Repeated items and rows each count. Every text is read whole, in one
    scan without a shuffle for each block of at most block items and chars characters (an item that is longer is one alone). Of several
    blocks, each is done, its matches written and its broadcast given back, before the next one is read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, match_end int"

    def found(sent) -> DataFrame:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, ids = _worker(sent), sent.value[2]
            for b in batches:
                rows: list[tuple] = []
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    for i, (dist, end) in m.find(t.as_py()).items():
                        rows += [(d, x, dist, end) for x in ids[i]]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "match_end"])

        return base.mapInArrow(f, schema)

    out = before = None
    for part in _blocks(benchmark, block, chars):
        if before is not None:
            done = cut(found(before), "matches")
            before.unpersist()
            out = done if out is None else out.unionByName(done)
        before = _sent(spark, part)
    if before is None:
        return spark.createDataFrame([], schema)
    return found(before) if out is None else out.unionByName(found(before))


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, chars: int = CHARS) -> DataFrame:
    """The rows of docs without any match, all columns. Rows with a null doc_id are judged by their text too. Rows are judged where they
    are read, block after block of the benchmark in one scan: nothing is shuffled or joined."""
    for part in _blocks(benchmark, block, chars):
        sent = _sent(docs.sparkSession, part)

        def f(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = _worker(sent)
            for b in batches:
                yield b.filter(pa.array([not m.find(t) for t in b.column("text").cast(pa.string()).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(f, docs.schema)
    return docs
