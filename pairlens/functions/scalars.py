"""Column functions: ties, bands, hash draws, rounding and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def half_wins(a: Column, b: Column) -> Column:
    """2 where a wins, 1 for an exact tie, 0 else: whole numbers, so sums are exact."""
    return F.when(a > b, 2).when(a == b, 1).otherwise(0)


def winner(a: Column, b: Column) -> Column:
    return F.when(a > b, "a").when(a < b, "b").otherwise("tie")


def band(pct: Column, low: float | Column = 30, high: float | Column = 70) -> Column:
    """Category of a percentage: ``b`` under low, ``a`` over high, ``neutral`` from 40 to 60, ``drop`` else."""
    return F.when(pct < low, "b").when(pct > high, "a").when(pct.between(40, 60), "neutral").otherwise("drop")


def leans(category: Column, a: Column, b: Column) -> Column:
    """Does the pair lean as its category says?"""
    return ((category == "a") & (a > b)) | ((category == "b") & (a < b))


def hash_int(*parts: Column | str | int) -> Column:
    """48 bits of the MD5 of the joined parts; the source of every draw, the same on any partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 12), 16, 10).cast("long")


def pick(n: Column | int, *parts: Column | str | int) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(hash_int(*parts), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def tiebreak(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def six(x: Column) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def significant(x: Column, digits: int = 4) -> Column:
    """x to some significant figures."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def direction(low: Column, high: Column) -> Column:
    """What an interval says about 50."""
    return F.when(low > 50, "a").when(high < 50, "b").otherwise("unclear")


def bias_label(share: Column) -> Column:
    return F.when(share >= 0.75, "strong").when(share >= 0.65, "moderate").when(share >= 0.55, "weak").otherwise("none")


@F.pandas_udf(DoubleType())
def bf16(x: pd.Series) -> pd.Series:
    """Nearest value with bfloat16's 16 bits, ties to even."""
    bits = x.to_numpy(np.float32).view(np.uint32).astype(np.uint64)
    bits = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16 << 16
    out = bits.astype(np.uint32).view(np.float32).astype(float)
    return pd.Series(np.where(np.isfinite(x.to_numpy(float)), out, x))


def decimal(x: Column) -> Column:
    """The shortest decimal of a double, exactly; means of these tie where the written numbers do."""
    return x.cast("string").cast("decimal(38,18)")


def construction(mode: Column, in_window: Column) -> Column:
    """How a pair of texts was built; an unknown mode is an error, not a group of its own."""
    swap = F.when(in_window, "swap_in_window").otherwise("swap_truncated")
    return F.when(mode == "inject", "prepended").when(mode == "swap", swap).otherwise(F.raise_error(F.concat(F.lit("unknown construction mode "), F.coalesce(mode, F.lit("null")))))


def drop_reason(title: Column, pct: Column) -> Column:
    """Why a label was dropped; one that no rule explains is an error rather than a guess."""
    unclear = ((pct >= 30) & (pct < 40)) | ((pct > 60) & (pct <= 70))
    said = F.raise_error(F.concat(F.lit("no reason to drop a label with a share of "), pct.cast("string")))
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no title").when(pct.isNull(), "suppressed").when(unclear, "ambiguous share").otherwise(said)
