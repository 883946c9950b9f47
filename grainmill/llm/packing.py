"""Packing of token pieces into fixed sequences by linear grouping."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
#: Groups of large pieces, and the shares of a sequence above which a piece is large: all are planned, the
#: plan with the fewest sequences is used. (Above a half, each combination is of one large piece.)
GROUPS, LARGE = 64, (1 / 4, 1 / 3, 1 / 2)
#: Words whose ids a worker keeps, about 150 bytes each; beyond that it begins anew.
CACHE = 400_000
#: Longer words go to the tokenizer.
LONGEST = 64
#: The plan that goes to the workers follows the number of lengths, not the corpus; this is checked.
MAX_PLAN = 2_000_000
BUCKET = 20_000

#: Texts of these characters alone are split here: basic Latin letters, ASCII digits, marks and white space.
_FAST = re.compile(r"[\t-\r -~À-ÖØ-öø-įĲ-ſ]*\Z")
#: The tokenizer's pre-tokens, for lower-case texts of those characters.
_WORDS = re.compile(r"[a-zß-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ſ0-9\t-\r ]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SLOTS = 1 << 18


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Merges:
    """Byte-pair merges of many words at once: in each round every word's pair of the least rank, of equal ones the first, is made one."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letter = _byte_letters()
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        self.bits = np.int64(max(vocab.values()).bit_length())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([(vocab[a] << int(self.bits)) | vocab[b] for a, b in pairs], np.int64)
        self.to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys, self.rank = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int64)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):  # open addressing: each round, one key settles in each free slot
            slot = (self._hash(keys[todo]) + self.probes) & (_SLOTS - 1)
            free = self.keys[slot] < 0
            where, first = np.unique(slot[free], return_index=True)
            self.keys[where], self.rank[where] = keys[todo[free][first]], todo[free][first]
            todo, self.probes = np.setdiff1d(todo, todo[free][first]), self.probes + 1

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        out, left, h = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._hash(keys)
        for p in range(self.probes):
            slot = (h[left] + p) & (_SLOTS - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rank[slot[hit]]
            left = left[(there >= 0) & ~hit]
            if not len(left):
                break
        return out

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one word after another, and where each begins (one more at the end)."""
        raw = [w.encode() for w in words]
        n = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), n)
        end = np.zeros(len(data), bool)
        end[np.cumsum(n) - 1] = True
        symbol = np.where(end, self.last[data], self.inner[data])
        parts, owners = [], []
        while True:
            at = np.flatnonzero(owner[1:] == owner[:-1])
            rank = self._ranks((symbol[at] << self.bits) | symbol[at + 1])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                parts.append(symbol)
                owners.append(owner)
                break
            mine = owner[at]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            least = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first) & 0xFFFFFFFF
            symbol[at[least]] = self.to[rank[least]]
            keep = np.ones(len(symbol), bool)
            keep[at[least] + 1] = False
            active = np.zeros(len(raw), bool)
            active[mine[first]] = True
            on = active[owner]
            parts.append(symbol[keep & ~on])
            owners.append(owner[keep & ~on])
            symbol, owner = symbol[keep & on], owner[keep & on]
        symbol, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.searchsorted(owner[order], np.arange(len(raw) + 1))


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Texts of basic Latin letters are cut into the tokenizer's pre-tokens here and each word is merged once, many
    at a time; other texts, those that hold a special token, and tokenizers of another make go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        model, pre = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        norm = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.fast = (
            norm == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": _SPLIT}
            and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and bool(model.get("end_of_word_suffix"))
        )
        if self.fast:
            self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        long = [w for w in words if len(w) > LONGEST]
        if long:
            words = [w for w in words if len(w) <= LONGEST]
        for i in range(0, len(words), 20_000):
            ids, at = self.merges.ids(words[i : i + 20_000])
            self._add(words[i : i + 20_000], ids, at)
        for w in long:
            ids = np.array(self.whole.encode(w, add_special_tokens=False).ids, np.int64)
            self._add([w], ids, np.array([0, len(ids)]))

    def _add(self, words: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words))))
        self.at = np.concatenate([self.at, at[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.index) > CACHE:
            self._forget()
        split = [_WORDS.findall(t.lower()) if self.fast and _FAST.match(t) and not any(x in t for x in self.special) else None for t in texts]
        words = [w for ws in split if ws for w in ws]
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[k] for k in new)))
            rows[new] = [self.index[words[k]] for k in new]
        n = self.at[rows + 1] - self.at[rows]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.at[rows] - to[:-1], n) + np.arange(to[-1])]
        place = 0
        for t, ws in zip(texts, split):
            if ws is None:
                yield np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int64)
            else:
                yield ids[to[place] : to[place + len(ws)]]
                place += len(ws)


_encoders: dict[str, Encoder] = {}


def _cut_up(path: str, capacity: int, end: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        e = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows: list[tuple] = []
                for d, ids in zip(part.column("doc_id").to_pylist(), e.encode([t or "" for t in part.column("text").to_pylist()])):
                    a = np.append(ids, end).astype("<u4")
                    for k in range(0, len(a), capacity):
                        x = a[k : k + capacity]
                        rows.append((d, k // capacity, k, len(x), zlib.crc32(x.tobytes())))
                cols = zip(*rows)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return f


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination of the sizes: the linear programme over all combinations,
    its columns made as needed by a knapsack over the dual prices, rounded down."""
    m = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    most = capacity // min(sizes)
    for _ in range(60 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        best = np.zeros(capacity + 1)
        picks = []
        for _ in range(most):
            new, pick = best.copy(), np.full(capacity + 1, -1)
            for j, s in enumerate(sizes):
                v = np.full(capacity + 1, -np.inf)
                v[s:] = best[: capacity + 1 - s] + price[j]
                better = v > new + 1e-12
                new[better], pick[better] = v[better], j
            picks.append(pick)
            best = new
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        use, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = np.maximum(use[up], 0) / step[up]
        if not up.any():
            break
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, need)
    return [(tuple(int(x) for x in basis[:, k]), int(use[k] + 1e-9)) for k in np.argsort(-use) if use[k] >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = 1 / 3) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, first rank, pieces, first sequence, offset); the pieces
    with ranks from first rank on go one by one into the sequences from first sequence on.

    Full pieces have their own sequences. Large ones, by falling length, are dealt into groups of equal
    cardinality whose lengths all count as the group's longest; combinations of these few sizes are
    optimised, then filled with actual pieces of each group. What is left over, and the small ones,
    go where they fit best, longest first. Everything works on counts of lengths, so its cost depends on the
    number of lengths and not of pieces.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    sequences = 0
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    left = {n: c for n, c in counts.items() if c > 0}

    def put(n: int, c: int, seq: int, offset: int) -> None:
        rows.append((n, used[n], c, seq, offset))
        used[n] += c
        left[n] -= c

    if left.get(capacity):
        put(capacity, left[capacity], 0, 0)
        sequences = used[capacity]
    big = [(n, left[n]) for n in sorted(left, reverse=True) if capacity > n > capacity * large]
    total = sum(c for _, c in big)
    groups = max(1, min(groups, total // 4))  # of four pieces at least
    if total:
        runs: list[list[list[int]]] = [[] for _ in range(groups)]
        pos = 0
        for n, c in big:
            while c:
                g = min(pos * groups // total, groups - 1)
                stop = -(-(g + 1) * total // groups)
                take = min(c, max(1, stop - pos))
                runs[g].append([n, take])
                pos, c = pos + take, c - take
        runs = [r for r in runs if r]
        merged: list[list[list[int]]] = []
        for r in runs:  # groups of one size are one
            if merged and merged[-1][0][0] == r[0][0]:
                merged[-1] += r
            else:
                merged.append(r)
        sizes = [r[0][0] for r in merged]
        for combo, times in configurations(sizes, [sum(c for _, c in r) for r in merged], capacity):
            slots = [j for j, k in enumerate(combo) for _ in range(k)]
            while times and slots:
                if any(sum(c for _, c in merged[j]) < slots.count(j) for j in set(slots)):
                    break
                # so many sequences alike: every slot's run must last
                n_run = times
                for j in set(slots):
                    n_run = min(n_run, max(1, merged[j][0][1] // slots.count(j)))
                at = 0
                for j in slots:
                    k = n_run
                    seq = sequences
                    if merged[j][0][1] >= k:
                        n = merged[j][0][0]
                        put(n, k, seq, at)
                        merged[j][0][1] -= k
                        if not merged[j][0][1]:
                            merged[j].pop(0)
                    at += n
                room[capacity - at].append((sequences, n_run))
                sequences += n_run
                times -= n_run
    for n in sorted(left, reverse=True):
        while left[n]:
            r = next((r for r in range(n, capacity + 1) if room[r]), None)
            if r is None:
                per = capacity // n
                bins = -(-left[n] // per)
                room[capacity].append((sequences, bins))
                sequences += bins
                r = capacity
            seq, bins = room[r].pop()
            # a fresh sequence is filled with pieces of this length before the next one is begun
            k = min(bins, left[n] if r < capacity else -(-left[n] // (capacity // n)))
            put(n, k, seq, capacity - r)
            room[r - n].append((seq, k))
            if k < bins:
                room[r].append((seq + k, bins - k))
    return rows


def sequences_of(rows: list[tuple[int, int, int, int, int]]) -> int:
    return max((seq + k for _, _, k, seq, _ in rows), default=0)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every row of docs (doc_id, text) as tokens, cut
    and packed into sequences of at most capacity tokens.

    A document is its text's ids and then end; only longer ones are cut, into pieces of capacity tokens and a
    rest. A null or empty text is the one id end. Null ids and repeated rows are packed like others; other columns
    are ignored; an empty table gives an empty result. Sequences are filled from offset 0 without gaps.

    One scan tokenizes. The counts of the lengths, at most capacity of them, are all that the plan is made of.
    Ranks within a length are taken in hashed buckets and from the buckets' counts, so a length with a third of
    all rows is no one task's.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(base.mapInArrow(_cut_up(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    rows = min((plan(counts, capacity, large=x) for x in LARGE), key=sequences_of)
    if len(rows) > MAX_PLAN:
        raise ValueError(f"the plan has {len(rows)} rows, more than {MAX_PLAN}")
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    buckets = max(1, sum(counts.values()) // BUCKET)
    hashed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    base_rank = hashed.groupBy("_b", "length").agg(F.count(F.lit(1)).alias("c")).select("_b", "length", (F.sum("c").over(Window.partitionBy("length").orderBy("_b")) - F.col("c")).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_b", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = hashed.withColumn("_k", local).join(base_rank, ["_b", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_k") - 1 + F.col("_base")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            k = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(t[k, 3] + rank - t[k, 1]), pa.array(t[k, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
