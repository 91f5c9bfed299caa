"""Acceptance of titles that differ a little."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quirelight.functions.text import title_key

#: Matching share from which two normalised titles count as one.
ACCEPT = 0.88


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 x matching characters / all characters, by longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def same_title(a: Column, b: Column) -> Column:
    """One normalised title contains the other, or they match to ``ACCEPT``; empty titles match
    nothing. Containment is decided in the JVM, only the rest reaches Python."""
    x, y = title_key(a), title_key(b)
    inside = x.contains(y) | y.contains(x)
    rest = _ratio(F.when(~inside, x), F.when(~inside, y)) >= ACCEPT
    return (x != "") & (y != "") & (inside | rest)
