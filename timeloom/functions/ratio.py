"""How alike two texts are: twice the characters in matching blocks over all characters, of texts without white space.

Finding blocks takes time with the product of the lengths. No ratio is higher than what the lengths allow, nor than what
the characters allow that both texts have, whatever their order; so a pair that must reach a ratio is asked for these
first, for columns in Spark, and only what is left has its blocks matched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(text: str | None) -> str:
    return "".join((text or "").split()).lower()


def ratio(a: str, b: str) -> float:
    """The ratio of two squeezed texts, 0 if either is empty; its arguments don't commute."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the ratio of two squeezed texts is at least ``least``: by their lengths, their characters, then their blocks."""
    if not a or not b:
        return least <= 0
    both = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * both or 2 * sum((Counter(a) & Counter(b)).values()) < least * both:
        return False
    return ratio(a, b) >= least


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts can't exceed, by the characters that both have."""
    return let(F.struct(_squeezed(a).alias("x"), _squeezed(b).alias("y")), lambda t: _bound(t["x"], t["y"]))


def _bound(x: Column, y: Column) -> Column:
    """bound() of texts that are squeezed."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(x, c), times(y, c))))
    both = F.length(x) + F.length(y)
    by_length = 2 * F.least(F.length(x), F.length(y)) / both
    return F.when((F.length(x) > 0) & (F.length(y) > 0), F.least(by_length, 2 * shared / both)).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def similarity(a, b):
    """The matching-blocks ratio of two texts (0 if either is empty)."""
    return pd.Series([ratio(squeeze(x), squeeze(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio of two texts is at least ``least``; blocks are matched only where the bound allows it."""
    # no double is so exact that a bound may not round below a ratio that equals it
    # (written out: Spark takes no function with variables as an argument of a Python function)
    may = _bound(_squeezed(a), _squeezed(b)) >= least - 1e-9
    return F.coalesce(similarity(F.when(may, a), F.when(may, b)) >= least, F.lit(False))
