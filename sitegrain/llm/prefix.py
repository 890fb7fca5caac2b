"""Running sums, minima and maxima over keys of any size.

A window over a key is one task however many rows the key has.  Here the rows are cut into slices of the global order
first, each about a task's share; a window runs inside one key of one slice, and what the key's earlier slices add
comes from their totals, of which a key has at most one a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SLICE = "slice"


def in_slices(rows: DataFrame, *order: str, tag: str = "slices") -> DataFrame:
    """``rows`` in a table of the shared folder, with the number of the range of ``order`` that holds each row.

    Rows that agree in ``order`` lie in one range, so it must tell rows apart where many could agree.
    """
    return materialize(rows.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), tag)


def running(rows: DataFrame, by: list[str], order: list[str], reverse: bool = False, inclusive: bool = True, **values: tuple) -> DataFrame:
    """``rows`` of :func:`in_slices` with a column for each ``name=(function, column)``: the function over the rows of
    the same ``by`` up to this one, or from this one where ``reverse``; without the row itself unless ``inclusive``.

    ``order`` is that of the slices, ``by`` holds no nulls, a function is ``F.sum``, ``F.min`` or ``F.max``; where no
    row has a value, sums are 0 and the others null.
    """
    turn = (lambda c: F.desc(c)) if reverse else F.asc
    here = Window.partitionBy(SLICE, *by).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = rows.groupBy(SLICE, *by).agg(*[f(c).alias(name) for name, (f, c) in values.items()])
    earlier = Window.partitionBy(*by).orderBy(turn(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(SLICE, *by, *[f(name).over(earlier).alias(f"_{name}") for name, (f, _) in values.items()])
    inside = rows.select("*", *[f(c).over(here).alias(name) for name, (f, c) in values.items()])
    both = inside.join(before, [SLICE, *by])
    return both.withColumns({name: _joined(f, F.col(f"_{name}"), F.col(name)) for name, (f, _) in values.items()}).select(*rows.columns, *values)


def _joined(function, before: Column, here: Column) -> Column:
    if function is F.sum:
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return (F.least if function is F.min else F.greatest)(before, here)
