"""Longest-matching-block similarity of text pairs; pairs must come from an equality join."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from clausework.functions.text import _c


@F.pandas_udf(DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two normalised titles."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)])


@F.pandas_udf(StructType([StructField("size", LongType()), StructField("coverage", DoubleType())]))
def longest_block(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Longest common block of two compact texts and its share of the shorter one."""
    rows = []
    for a, b in zip(left, right):
        size = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size if a and b else 0
        rows.append((size, size / min(len(a), len(b)) if size else 0.0))
    return pd.DataFrame(rows, columns=["size", "coverage"])


def edit_ratio(left, right) -> Column:
    """1 - edit distance / longer length; a built-in prefilter, not a substitute for block_ratio."""
    a, b = _c(left), _c(right)
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
