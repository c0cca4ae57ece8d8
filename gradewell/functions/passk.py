"""pass@k as a pure column expression (no factorials, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The k values every report shows.
K_VALUES = (1, 3, 5)


def pass_at_k(n: Column | str, c: Column | str, k: int) -> Column:
    """Unbiased pass@k estimator for ``n`` samples with ``c`` correct.

    Case order matters and follows the reference estimator:
    n < k -> 0; c = n -> 1; c = 0 -> 0; n - c < k -> 1;
    else 1 - C(n-c, k) / C(n, k), written as the product
    prod_{j<k} (n-c-j)/(n-j) so huge n never overflows.
    """
    n = F.col(n) if isinstance(n, str) else n
    c = F.col(c) if isinstance(c, str) else c
    nd = n.cast("double")
    cd = c.cast("double")
    prod = F.lit(1.0)
    for j in range(k):
        prod = prod * (nd - cd - F.lit(float(j))) / (nd - F.lit(float(j)))
    return (
        F.when(n < k, F.lit(0.0))
        .when(c == n, F.lit(1.0))
        .when(c == 0, F.lit(0.0))
        .when(n - c < k, F.lit(1.0))
        .otherwise(F.lit(1.0) - prod)
    )


def pass_at_k_sql(n: str, c: str, k: int) -> str:
    """Same estimator as ANSI SQL text (used by oracles and SQL users)."""
    prod = " * ".join(
        f"(CAST({n} AS DOUBLE) - CAST({c} AS DOUBLE) - {j}.0) / (CAST({n} AS DOUBLE) - {j}.0)"
        for j in range(k)
    )
    return (
        f"CASE WHEN {n} < {k} THEN 0.0 WHEN {c} = {n} THEN 1.0 WHEN {c} = 0 THEN 0.0 "
        f"WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - ({prod}) END"
    )
