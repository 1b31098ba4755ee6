"""Columns that are computed once per row, whatever is done with them later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, behind a generator.

    Spark moves a filter below a projection by copying the projected expression
    into it. For long expressions (parsing, URL resolution) the copies multiply;
    a generator's output stays where it is, while filters on the other columns
    still move down.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline_outer(packed).alias(*columns))


def present(df: DataFrame, column: str, value: Column, when: Callable[[Column], Column] = Column.isNotNull) -> DataFrame:
    """``df`` with one more column and without the rows for which ``when`` does not hold of it.

    Like ``once`` and a filter. The rows go in a generator behind the projection, so the filter
    stays above it, too, and Spark compiles expressions with lambdas in them, which it
    interprets in a generator.
    """
    kept = F.explode(F.when(when(F.col("_present")), F.array("_present"))).alias(column)
    return df.select("*", value.alias("_present")).select(*df.columns, kept)
