"""Where an expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(column: Column) -> Column:
    """The column, evaluated once per row however often it is used.

    For an expensive expression that filters refer to: Catalyst moves a filter
    below the projection it follows and puts the expression into it, again for
    each reference. It does not do so through a generator. One row stays one row.
    """
    return F.explode(F.array(column))
