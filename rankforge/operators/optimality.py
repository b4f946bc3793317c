"""Whether user factors are the optimum that implicit training defines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators.objective import gram
from rankforge.operators.rating_blocks import deal


def user_optimality(
    ratings: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    rank: int,
    regularization: float,
    alpha: float,
    tolerance: float = 1e-3,
) -> DataFrame:
    """``userId, converged`` for every user with factors and ratings.

    The last half step of training solves, for the factors x of a user with n
    ratings r of items y, (Y'Y + lambda n) x + sum alpha r (y.x) y =
    sum (1 + alpha r) y. Converged means that the sides differ by at most
    ``tolerance`` of the right one. Ratings must be positive; Y'Y is over all
    items and is one row.
    """

    def terms(x: np.ndarray, y: np.ndarray, rating: np.ndarray) -> np.ndarray:
        c = alpha * rating[:, None]
        # Sums only, no outer products: rank numbers a side.
        return np.hstack((np.ones_like(c), (1 + c) * y, c * (x * y).sum(1)[:, None] * y))

    # An item's vector is sent once to each block of users, not once a rating.
    summed = deal(ratings, "userId").sums(terms, 1 + 2 * rank, rank, others=item_factors, own=user_factors)
    sides = summed.selectExpr(
        "id AS userId", "own AS x", "sums[0] AS n",
        f"slice(sums, 2, {rank}) AS right", f"slice(sums, {rank} + 2, {rank}) AS left",
    )
    gap = (
        f"transform(right, (r, i) -> r - left[i] - {regularization}D * n * x[i] - aggregate("
        f"zip_with(slice(gram, i * {rank} + 1, {rank}), x, (g, v) -> g * v), 0D, (s, e) -> s + e))"
    )
    length = "sqrt(aggregate({}, 0D, (s, e) -> s + e * e))"
    return (
        sides.withColumn("gram", gram(item_factors, rank).scalar())
        .withColumn("gap", F.expr(gap))
        .selectExpr("userId", f"{length.format('gap')} <= {tolerance}D * {length.format('right')} AS converged")
    )
