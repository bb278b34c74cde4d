"""Sizes and number formats."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from tarnflow.schemas import GIB, KIB, MIB, GraphError


def parse_size(text: str) -> int:
    """Bytes of a whole number with an optional K, M or G (binary); zero and anything else is an error."""
    m = re.fullmatch(r"([0-9]+)([KMGkmg]?)", text)
    size = int(m[1]) * {"": 1, "K": KIB, "M": MIB, "G": GIB}[m[2].upper()] if m else 0
    if not 0 < size < 1 << 64:
        raise GraphError(f"invalid size: '{text}'")
    return size


def format_rank(x: float) -> str:
    return format(x, ".15g")


def rank_text(column):
    """Ranks as text with 15 significant digits.  The JVM's own formatter rounds the shortest form, so its last digit differs."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: format(x, ".15g"))

    return text(column)
