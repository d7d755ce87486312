"""Folds that Spark has no aggregate for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def divisors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The greatest common divisor of each symbol's values in a partition."""
    so_far: dict[int, int] = {}
    for pdf in batches:
        for symbol, v in pdf.groupby("symbol")["v"]:
            so_far[symbol] = int(np.gcd.reduce(v.to_numpy(), initial=so_far.get(symbol, 0)))
    yield pd.DataFrame(so_far.items(), columns=["symbol", "v"]).astype("int64")
