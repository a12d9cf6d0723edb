"""Dealing rows by ranges of ids, for work that needs the order of ids but not one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Characters that one range of ids should hold.
RANGE_CHARS = 24_000_000


def numbered_ranges(rows: DataFrame, range_chars: int = RANGE_CHARS) -> tuple[DataFrame, int]:
    """``rows`` (_id bigint, _text) with _range, ascending with the id, and the number of ranges.

    Cut points are quantiles of the ids; there are as many ranges as the texts' length asks for. Null ids are in range 0.
    """
    n_chars, n_ids = rows.agg(F.sum(F.length("_text") + 1), F.count("_id")).first()
    n = max(1, -(-(n_chars or 0) // range_chars))
    cuts = sorted(set(rows.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0])) if n > 1 and n_ids else []
    shared = rows.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(np.int64), side="left").astype(np.int32))

    return rows.withColumn("_range", range_of(F.coalesce("_id", F.lit(-(1 << 63))))), len(cuts) + 1
