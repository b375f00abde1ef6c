"""Small result tables as text, and numbers filled into text by path.

Renderers collect: they are for result tables of some hundred rows, and refuse larger ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 10_000


def _rows(df: DataFrame, columns: list[str], digits: int, order: str) -> list[list[str]]:
    got = df.select(*columns).orderBy(order).limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"more than {MOST} rows to render")
    return [[number(v, digits) if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in got]


def number(v: float, digits: int) -> str:
    out = f"{v:.{digits}f}"
    return out.lstrip("-") if float(out) == 0 else out


def tabular(df: DataFrame, columns: list[str], digits: int, order: str) -> str:
    align = "".join("l" if t == "string" else "r" for t in (dict(df.dtypes)[c] for c in columns))
    lines = [" & ".join(r) + r" \\" for r in [columns, *_rows(df, columns, digits, order)]]
    return f"\\begin{{tabular}}{{{align}}}\n" + "\n".join(lines) + "\n\\end{tabular}\n"


def markdown(df: DataFrame, columns: list[str], digits: int, order: str) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *_rows(df, columns, digits, order)])


def paged(df: DataFrame, height: str, most: int, order: str, *by: str) -> DataFrame:
    """Greedy pages of rows whose heights sum to ``most``: a fold over the ordered rows of each (small) table."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    heights = F.transform(F.sort_array(F.collect_list(F.struct(order, height)).over(w)), lambda x: x[height])
    n = F.row_number().over(w.orderBy(order))
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("page"))

    def step(acc, h):
        new = acc["used"] + h > most
        return F.struct(F.when(new, h).otherwise(acc["used"] + h).cast("int").alias("used"), (acc["page"] + F.when(new & (acc["used"] > 0), 1).otherwise(0)).cast("int").alias("page"))

    return df.withColumn("__h", heights).withColumn("__n", n).withColumn("page", F.aggregate(F.slice("__h", F.lit(1), F.col("__n")), start, step)["page"]).drop("__h", "__n")


class Numbers:
    """Values of nested results by path; a path that is not there is an error."""

    def __init__(self, data: dict) -> None:
        self.data = data

    def value(self, path: str):
        at = self.data
        for part in path.split("."):
            try:
                at = at[int(part)] if isinstance(at, list) else at[part]
            except (KeyError, IndexError, ValueError) as e:
                raise KeyError(path) from e
        return at

    def fill(self, text: str) -> str:
        return re.sub(r"\{\{([^}|]+)(?:\|([^}]*))?\}\}", lambda m: format(self.value(m[1]), m[2] or ""), text)
