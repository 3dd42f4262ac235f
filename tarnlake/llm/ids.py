"""Row ids across the Arrow boundary: a null among them must not turn the others into floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ID, NONE = "own_id", "own_id_is_null"


def id_columns(name: str = "doc_id") -> list[Column]:
    """Two columns without nulls that hold an id exactly."""
    return [F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(ID), F.col(name).isNull().alias(NONE)]


def ids_of(df: pd.DataFrame, rows: np.ndarray | None = None) -> pd.arrays.IntegerArray:
    """The ids of a batch with those columns, of the given rows or of all."""
    values, null = df[ID].to_numpy(np.int64), df[NONE].to_numpy(bool)
    return pd.arrays.IntegerArray(values, null) if rows is None else pd.arrays.IntegerArray(values[rows], null[rows])
