"""From banded candidates to verified connected groups, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, give_back, sieve
from .components import components

#: Rounds of comparing with pivots at most. No further one is made with FEW possible pairs for each member, or after less than one link for
#: WORTH members.
ROUNDS, FEW, WORTH = 4, 2, 50
#: Keys and elements are counted in passes of 2 ** PASS each, PASSES at most.
PASS, PASSES = 22, 16
#: 64-bit numbers of a set's bitmap, where group() isn't given another number. Members of larger buckets than LARGE aren't compared pair by pair.
WORDS, LARGE = 16, 4096
#: So many numbers of a bitmap are made at a time: a row of an element is looked at once for each.
SPAN = 16


def _passes(n: int) -> int:
    return min(PASSES, max(1, n >> PASS))


def shared_keys(signed: DataFrame, name: str) -> DataFrame:
    """(key, id, sk, m): a row for each of the keys, in the array column name, of signed (id, sk, …) that at least two ids have, with
    that number as m.

    Of many keys, a share is looked at in each pass, so what is shuffled at a time stays small. Counts are partially aggregated before the
    shuffle. Where a pass's shared keys fit a bounded Bloom filter, rows with a key of their own don't reach the second shuffle.
    """
    bands = signed.select(F.explode(name).alias("key"), "id", "sk")
    passes = _passes(signed.agg(F.sum(F.size(name))).first()[0] or 0)
    out = None
    for k in range(passes):
        part = bands if passes == 1 else bands.where(F.pmod("key", F.lit(passes)) == k)
        multi = cut(part.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "keys")
        may = sieve(multi.select("key"), multi.count())
        rows = part if may is None else may(part, F.col("key")).where("_hit").drop("_hit")
        members = cut(rows.join(multi, "key"), "members")
        drop(multi)
        out = members if out is None else out.unionByName(members)
    return cut(out, "members") if passes > 1 else out


#: Fields of a sketch, three bits each in a 64-bit number, and how many of them linked ids share at least: at a similarity of 0.8 fewer
#: agree once in 300,000 times.
FIELDS, AGREE = 20, 8


def _agree(a: str, b: str, sketch: tuple[int, int, int]) -> Column:
    """Whether two sketches, of so many fields of so many bits, agree in enough fields."""
    fields, bits, agree = sketch
    x = F.col(a).bitwiseXOR(F.col(b))
    differ = x
    for j in range(1, bits):
        differ = differ.bitwiseOR(F.shiftrightunsigned(x, j))
    return fields - F.bit_count(differ.bitwiseAND(F.lit(sum(1 << bits * j for j in range(fields))))) >= agree


def group(members: DataFrame, items_of: Callable[[DataFrame], DataFrame], set_of: Callable[[Column], Column], percent: int = 80, sketch: tuple[int, int, int] = (FIELDS, 3, AGREE), elements_of: Callable[[DataFrame], DataFrame] | None = None, words: int = WORDS) -> DataFrame:
    """(id, component) of the ids linked at a Jaccard similarity of percent or more.

    members: (key, id, sk, m): sk is a sketch of the id's set, so many fields of so many bits as sketch says
    with the number in which linked ids agree, and m the bucket's size. items_of: from a one-column table of ids to (id, n, item), n the size of the
    set, null where it isn't known; set_of makes of an item the whole set, an array without repeats. elements_of, where that is cheaper: from items to
    (id, n, x), a row for each element, repeats allowed, n no less than the set's size; for pivots only. words: the size of the bitmaps of what is left after the pivots; larger ones let fewer pairs through.

    First every bucket's members are compared with one of them, the one that shares most
    buckets. That is linear in the bucket and links a group of near copies nearly whole. The pivot then leaves the bucket, as
    its links there are all known, and a bucket leaves whose members one component holds. While many pairs are left
    between different components, this is repeated, ROUNDS times at most: the links between components are found by
    few comparisons of their many. Then nothing but exact bounds say which pairs of the rest are judged, by their bitmaps. Before any set is
    moved for a pivot, a pair must agree in its sketches and may be similar by its bitmaps. Pairs are judged by whole sets.
    """
    ids = cut(members.select("id").distinct(), "ids")
    items = cut(items_of(ids).select("id", "n", "item"), "items")
    bits = cut(bitmaps(elements_of(items) if elements_of else _elements(ids, items, set_of)), "bits")
    degree = members.groupBy("id").agg(F.sum("m").alias("deg")).join(items.select("id", "n"), "id")
    rest = cut(members.select("key", "id", "sk").join(degree, "id").withColumn("c", F.col("id")), "live")
    drop(ids)
    owner = links = None
    for _ in range(ROUNDS):
        spread = rest.groupBy("key").agg(F.max(F.struct("deg", (-F.col("id")).alias("i"), "n", "sk", "c")).alias("z"))
        pivot = spread.select("key", (-F.col("z.i")).alias("p"), F.col("z.n").alias("pn"), F.col("z.sk").alias("psk"), F.col("z.c").alias("pc"))
        size = F.coalesce(100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"), F.lit(True))
        own = cut(rest.join(pivot, "key").where("id <> p").withColumn("near", (F.col("c") != F.col("pc")) & size & _agree("sk", "psk", sketch)), "own")
        pairs = own.where("near").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        new = cut(linked(_near(pairs, bits, percent), items, set_of, percent), "links")
        if owner is None:
            links, owner = new, cut(components(new), "owner")
        elif not new.isEmpty():
            links = links.unionByName(new)
            owner = cut(components(links), "owner")
        named = own.select("key", "id", "sk", "deg", "n").join(owner.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
        # buckets in which several components are left, without their pivots
        several = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
        rest, before = cut(named.join(several, "key"), "open"), rest
        drop(own, before)
        # no more pairs than the buckets' sizes allow
        most, rows = rest.groupBy("key").count().agg(F.sum(F.expr("cast(count as decimal(38, 0)) * (count - 1) / 2")), F.sum("count")).first()
        if (most or 0) <= FEW * (rows or 0) or WORTH * new.count() < rows:
            break
    if rows:
        if words > WORDS or elements_of:
            # of the sets themselves, as the sizes of elements_of may be too large, and let any pairs through then
            drop(bits)
            bits = cut(bitmaps(_elements(rest.select("id").distinct(), items, set_of), words), "bits")
        some = cut(_met(rest, bits, items, set_of, percent), "pairs")
        more = cut(linked(some, items, set_of, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            owner = cut(components(links), "owner")
    drop(items, bits, rest)
    return owner


def _elements(ids: DataFrame, items: DataFrame, set_of: Callable[[Column], Column]) -> DataFrame:
    """(id, …, n, x) of ids (id, …): a row for each element x of an id's whole set, of n elements."""
    # in a lambda the set is made once
    sets = ids.join(items.select("id", "item"), "id").select(*ids.columns, F.explode(F.transform(F.array("item"), set_of)).alias("s"))
    return sets.select(*ids.columns, F.size("s").alias("n"), F.explode("s").alias("x"))


def bitmaps(elements: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, b0, b1, …) of elements (id, n, x), repeats allowed: so many 64-bit numbers, in which each element sets one bit."""
    h = F.xxhash64("x")
    each = elements.select("id", "n", F.pmod(h, F.lit(words)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63)).cast("int")).alias("m"))
    none = F.lit(0).cast("long")
    if words <= SPAN:
        return each.groupBy("id", "n").agg(*(F.bit_or(F.when(F.col("w") == j, F.col("m")).otherwise(none)).alias(f"b{j}") for j in range(words)))
    each = each.select("id", "n", F.floor(F.col("w") / SPAN).alias("g"), F.pmod("w", F.lit(SPAN)).alias("w"), "m")
    spans = each.groupBy("id", "n", "g").agg(*(F.bit_or(F.when(F.col("w") == j, F.col("m")).otherwise(none)).alias(f"p{j}") for j in range(SPAN)))
    return spans.groupBy("id", "n").agg(*(F.bit_or(F.when(F.col("g") == j // SPAN, F.col(f"p{j % SPAN}")).otherwise(none)).alias(f"b{j}") for j in range(words)))


def _words(bits: DataFrame) -> range:
    return range(len(bits.columns) - 2)


def _may(percent: int, words: range) -> str:
    """Whether two ids, a with na elements at most and the bitmap a0, a1, … and b alike, may be similar by percent. Bits that one of them alone has come
    from elements that it alone has, so there are no more of them than elements that sets so similar don't share: no pair is lost."""
    apart = " + ".join(f"bit_count(a{j} ^ b{j})" for j in words)
    return f"{100 + percent}L * ({apart}) <= {100 - percent}L * (na + nb)"


def _side(s: str, words: range) -> list[Column]:
    """The columns of bitmaps() under the names that _may() has for them."""
    return [F.col("id").alias(s), F.col("n").alias(f"n{s}"), *(F.col(f"b{j}").alias(f"{s}{j}") for j in words)]


def _near(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar by their bitmaps."""
    for s in "ab":
        pairs = pairs.join(bits.select(*_side(s, _words(bits))), s)
    return pairs.where(_may(percent, _words(bits))).select("a", "b")


def _met(rest: DataFrame, bits: DataFrame, items: DataFrame, set_of: Callable[[Column], Column], percent: int) -> DataFrame:
    """(a, b), distinct: the pairs of ids of different components, in a bucket of rest (key, id, c) together, that may be similar.

    Within buckets of up to LARGE members each pair's bitmaps are compared. Ids of larger buckets are found by rare_pairs() among each other, so that what is compared
    doesn't grow with the square of a bucket.
    """
    size = rest.groupBy("key").count()
    large = cut(rest.join(size.where(F.col("count") > LARGE).select("key"), "key").select("id", "c").distinct(), "large")
    every = large.isEmpty()
    few = rest.select("key", "id", "c") if every else rest.join(size.where(F.col("count") <= LARGE).select("key"), "key").select("key", "id", "c")
    out = meetings(few, bits, percent)
    if not every:
        tokens = _elements(large, items, set_of)
        tokens = cut(tokens.withColumn("x", F.shiftright("x", 32).cast("int")), "tokens")
        out = out.unionByName(rare_pairs(tokens, percent, bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    return out


def meetings(few: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of ids of different components in a bucket of few (key, id, c) together that may be similar by their bitmaps, whose n are the sets' sizes, each from the first bucket
    alone that it shares, whatever the number of those."""
    # the upper halves of an id's keys, which are hashes, tell its buckets apart
    size = f"100L * na >= {percent}L * nb and 100L * nb >= {percent}L * na"
    own = few.groupBy("id", "c").agg(F.collect_list("key").alias("own")).join(bits, "id")
    own = own.withColumn("k", F.transform("own", lambda x: F.shiftright(x, 32).cast("int"))).withColumn("key", F.explode("own"))
    sides = [own.select("key", *_side(s, _words(bits)), F.col("c").alias(f"c{s}"), F.col("k").alias(f"k{s}")) for s in "ab"]
    met = sides[0].join(sides[1], "key").where(f"a < b and ca <> cb and {size} and {_may(percent, _words(bits))} and shiftright(key, 32) = array_intersect(ka, kb)[0]")
    return met.select("a", "b")


def rare_pairs(tokens: DataFrame, percent: int, bits: DataFrame | None = None) -> DataFrame:
    """(a, b), distinct: every pair of ids of different components that may be similar by percent, of tokens (id, c, n, x), a table that cut()
    has written and this removes: a hash x of each element of an id's whole set, the set's size n, the id's component c. With bits, bitmaps() of the
    sets, pairs are left out of which those say that they aren't similar.

    All sets are put in one order, by how many ids have an element, those that one component alone has first. Sets that share so many elements as
    the threshold asks for share one of each one's first few: of the smaller set those beyond 2 percent / (100 + percent) of it, of the
    larger one those beyond percent. This holds for any order and for hashes that collide, so no pair is lost; with this order, texts that share a
    frequent frame and nothing else never meet, whatever their number.
    """
    passes = _passes(tokens.count())
    sized = cut(tokens.select("id", "c", "n").distinct(), "sized")
    met = []
    for k in range(passes):
        part = tokens.where(F.pmod("x", F.lit(passes)) == k)
        spread = part.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("x", "m")
        spread = cut(spread, "spread")
        met.append(cut(part.select("id", "x").join(spread, "x").select("id", "x", "m"), "met"))
        drop(spread)
    drop(tokens)
    # elements of one component alone join nothing, but count as the first of the order
    alone = F.col("n") - F.size("e")
    first = {"small": F.expr(f"n - cast(ceil(2 * {percent} * n / {100 + percent}D - 1e-9) as int) + 1"), "large": F.expr(f"n - cast(ceil({percent} * n / 100D - 1e-9) as int) + 1")}
    beginnings = [F.transform(F.slice("e", 1, F.greatest(F.lit(0), k - alone)), lambda z: z["x"]).alias(name) for name, k in first.items()]
    rare = None
    for k in range(passes):
        part = met[0]
        for more in met[1:]:
            part = part.unionByName(more)
        part = part.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "x"))).alias("e"))
        new = cut(part.join(sized, "id").select("id", "c", "n", *beginnings).where("size(large) > 0"), "rare")
        give_back(new)
        rare = new if rare is None else rare.unionByName(new)
    drop(*met)
    words = []
    if bits is not None:
        words = [f"b{j}" for j in _words(bits)]
        rare = rare.join(bits.select("id", *words), "id")
    small = rare.select(F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), *(F.col(w).alias(f"a{w[1:]}") for w in words), F.explode("small").alias("x"))
    large = rare.select(F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), *words, F.explode("large").alias("x"))
    pair = f"ca <> cb and (na < nb or na = nb and a < b) and 100L * na >= {percent}L * nb"
    return small.join(large, "x").where(f"{pair} and {_may(percent, _words(bits))}" if words else pair).select("a", "b").distinct()


def linked(pairs: DataFrame, items: DataFrame, set_of: Callable[[Column], Column], percent: int) -> DataFrame:
    """The pairs (a, b) that are similar by percent or more."""
    return overlaps(pairs, items, set_of).where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b")


def overlaps(pairs: DataFrame, items: DataFrame, set_of: Callable[[Column], Column]) -> DataFrame:
    """The pairs (a, b) with the sizes of their whole sets, na and nb, and of what both hold, i. Items are moved, and
    sets made of them where a pair meets."""
    left, right = (items.select(F.col("id").alias(x), F.col("item").alias(f"i{x}")) for x in "ab")
    sets = F.struct(set_of(F.col("ia")).alias("x"), set_of(F.col("ib")).alias("y"))
    # in a lambda the two sets are made once
    sizes = F.transform(F.array(sets), lambda z: F.struct(F.size(z["x"]).alias("na"), F.size(z["y"]).alias("nb"), F.size(F.array_intersect(z["x"], z["y"])).alias("i")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.inline(sizes))
