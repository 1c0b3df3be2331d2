"""Ranks and running sums over an ordering, without any unbounded window.

Rows carry two bucket columns that refine the ordering.  A histogram over the buckets
gives each bucket's starting value; only the rows of one (group, coarse, fine) cell meet
in a window, so a group that holds most of the table is spread over all its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE, FINE = 256, 4096


def hash_buckets(df: DataFrame, hex_col: str) -> DataFrame:
    """Add ``b1`` (2 hex digits) and ``b2`` (3 more) of a uniform hex digest."""
    return df.withColumns(
        {
            "b1": F.conv(F.substring(hex_col, 1, 2), 16, 10).cast("int"),
            "b2": F.conv(F.substring(hex_col, 3, 3), 16, 10).cast("int"),
        }
    )


def unit_buckets(df: DataFrame, x: str) -> DataFrame:
    """Add ``b1`` and ``b2`` that cut [0, 1) evenly; both follow the order of ``x``."""
    cell = F.floor(F.col(x) * (COARSE * FINE))
    return df.withColumns({"b1": F.floor(cell / FINE).cast("int"), "b2": (cell % FINE).cast("int")})


def running(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    measures: list[str],
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add, for each measure m, ``m_before`` (sum over earlier rows) and ``m_total``.

    ``group`` columns must not be null.  ``df`` should be a written table: it is read twice.
    ``per_group`` has a row for each group; its other columns reach the rows by way of the
    cells, so that no row is ever dealt out by its group alone.
    """
    hist = df.groupBy(*group, "b1", "b2").agg(*[F.sum(m).alias(m) for m in measures])
    upto = lambda keys, by: (
        Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    )
    coarse = hist.groupBy(*group, "b1").agg(*[F.sum(m).alias(m) for m in measures])
    coarse = coarse.select(
        *group,
        "b1",
        *[F.coalesce(F.sum(m).over(upto(group, "b1")), F.lit(0)).alias(f"{m}_c") for m in measures],
        *[F.sum(m).over(Window.partitionBy(*group)).alias(f"{m}_total") for m in measures],
    )
    if per_group is not None:
        coarse = coarse.join(per_group, group)
    known = {*group, "b1", "b2", *measures}
    more = [c for c in coarse.columns if c not in known and not c.endswith(("_c", "_total"))]
    fine = hist.select(
        *group,
        "b1",
        "b2",
        *[F.coalesce(F.sum(m).over(upto([*group, "b1"], "b2")), F.lit(0)).alias(f"{m}_f") for m in measures],
    )
    starts = fine.join(coarse, [*group, "b1"]).select(
        *group,
        "b1",
        "b2",
        *[(F.col(f"{m}_c") + F.col(f"{m}_f")).alias(f"{m}_start") for m in measures],
        *[f"{m}_total" for m in measures],
        *more,
    )
    cell = Window.partitionBy(*group, "b1", "b2").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*group, "b1", "b2"])
        .withColumns(
            {
                f"{m}_before": F.col(f"{m}_start") + F.coalesce(F.sum(m).over(cell), F.lit(0))
                for m in measures
            }
        )
        .drop(*[f"{m}_start" for m in measures], "b1", "b2")
    )
