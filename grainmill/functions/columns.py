"""Column factories: pure expressions that stay inside generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.strip() removes.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EOS = "<eos>"


def not_blank(text: Column) -> Column:
    """Whether a text holds anything but white space; false for null."""
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits."""
    return F.array_remove(F.split(text, "[^a-zA-Z0-9]+"), "")


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as integers."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.regexp_extract_all(h, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def with_eos(ids: Column, eos: Column) -> Column:
    """ids and then eos, unless they end with it; an empty array stays empty."""
    return F.when(F.size(ids) == 0, ids).when(F.element_at(ids, -1) == eos, ids).otherwise(F.concat(ids, F.array(eos)))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as floating-point numbers divide, by zero too, where Spark's own division is an error."""
    sign = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, F.when(a.isNotNull(), sign)).otherwise(a / F.nullif(b, F.lit(0.0)))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(80.0)))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once; named in a lambda, it would be computed for every element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def log_sum_exp(logits: Column) -> Column:
    def shifted(v: Column, top: Column) -> Column:
        return F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top

    return let(logits, lambda v: let(F.array_max(v), lambda top: shifted(v, top)))


def softmax(logits: Column) -> Column:
    return let(logits, lambda v: let(log_sum_exp(v), lambda z: F.transform(v, lambda x: F.exp(x - z))))


def cross_entropy(logits: Column, target: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, target)


def learning_rate(step: Column, top: float = 6e-4, low: float = 6e-5, warmup: int = 715, decay: int = 38146) -> Column:
    """Linear warm-up, half a cosine down to low, then constant."""
    ratio = (step - warmup) / (decay - warmup)
    cosine = low + 0.5 * (1 + F.cos(math.pi * ratio)) * (top - low)
    return F.when(step < warmup, top * (step + 1) / warmup).when(step > decay, F.lit(low)).otherwise(cosine)


def split_of(key: Column) -> Column:
    """train, validation or test, 90 to 5 to 5 in expectation, by a hash of the key."""
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 90, "train").when(bucket < 95, "validation").otherwise("test")
