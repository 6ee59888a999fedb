"""Pages of ordered rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in order, with has_next. One row more than the page is fetched to tell."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    ordered = Window.orderBy(*order)  # over limit + 1 rows at most
    counted = rows.withColumn("_n", F.row_number().over(ordered)).withColumn("_all", F.count("*").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return counted.withColumn("has_next", F.col("_all") > limit).where(F.col("_n") <= limit).drop("_n", "_all")


def after(order: list[tuple[str, bool]], cursor: dict) -> Column:
    """Row-value condition 'strictly after the cursor' for columns with their descending flags."""
    terms = []
    for i, (name, descending) in enumerate(order):
        same = [F.col(c) == F.lit(cursor[c]) for c, _ in order[:i]]
        here = F.col(name) < F.lit(cursor[name]) if descending else F.col(name) > F.lit(cursor[name])
        terms.append(reduce(lambda a, b: a & b, [*same, here]))
    return reduce(lambda a, b: a | b, terms)


def page_after(df: DataFrame, order: list[tuple[str, bool]], cursor: dict, limit: int) -> DataFrame:
    return page(df.where(after(order, cursor)), [F.col(c).desc() if d else F.col(c).asc() for c, d in order], limit)
