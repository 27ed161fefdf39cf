"""Similarity of strings that no built-in expression computes."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over both lengths, on longest matching blocks; argument order matters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


# So that Spark neither compares pairs again to filter by a column of ratios, nor before they are made distinct.
sequence_ratio = sequence_ratio.asNondeterministic()
