"""Edit distance that counts a swap of neighbours as one edit (optimal string alignment), in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf


def osa(a: str, b: str, most: int) -> int:
    """Distance of a and b; most + 1 stands for anything above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most and (not old or min(old) > most):
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def osa_column(query: str, most: int):
    @pandas_udf("int")
    def distance(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: osa(query, p, most))

    return distance
