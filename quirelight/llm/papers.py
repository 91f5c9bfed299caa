"""Reading rules shared by the problems: which row is the paper, what is blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.session import is_blank


def one_row_per_paper(rows: DataFrame, *columns: str) -> DataFrame:
    """Of each ``paper_id`` the row with the smallest ``input_row``, with ``columns``.

    A partial aggregate: a ``paper_id`` with a third of all rows is reduced before the
    shuffle. Rows without a ``paper_id`` are dropped (they have no key to report).
    """
    pick = F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(F.coalesce(F.col("input_row"), F.lit(2**62))))
    return (rows.where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(pick.alias("_r"))
            .select("paper_id", *[F.col(f"_r.{c}").alias(c) for c in columns]))


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Only the rows whose ``column`` is not blank."""
    return df.where(~is_blank(F.col(column)))
