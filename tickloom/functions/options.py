"""European options on a forward: prices, and the volatility that a price implies, whole columns at a time.

Prices are compared in one form: without discount and intrinsic value, in units of
the geometric mean of forward and strike. They depend on two numbers then, the log
moneyness and the deviation of the log price at expiry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults: yearly rate of discount, and the volatilities between which one is looked for.
RATE, LOWEST, HIGHEST = 0.065, 1e-4, 5.0
#: Relative change of a deviation at which it counts as found.
TOLERANCE = 1e-13
#: Coefficients of the rational form of the normal distribution (Hart 1968, as given by West 2005). Fixed values.
_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 14 digits."""
    a = np.abs(x)
    e = np.exp(-0.5 * a * a)
    tail = np.where(a < 7.07, e * np.polyval(_TOP, a) / np.polyval(_BOTTOM, a), e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / np.sqrt(2 * np.pi))
    return np.where(x > 0, 1 - tail, tail)


def time_value(distance: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """What an option is worth beyond its intrinsic value, for a log moneyness of +-distance (0 or more) and a deviation above 0."""
    with np.errstate(all="ignore"):
        z = -distance / deviation
        return np.exp(-distance / 2) * normal(z + deviation / 2) - np.exp(distance / 2) * normal(z - deviation / 2)


def _slope(distance: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """How fast the time value grows with the deviation."""
    with np.errstate(all="ignore"):
        return np.exp(-0.5 * ((distance / deviation) ** 2 + deviation**2 / 4)) / np.sqrt(2 * np.pi)


def price(forward: np.ndarray, strike: np.ndarray, years: np.ndarray, vol: np.ndarray, call: np.ndarray, rate: float = RATE) -> np.ndarray:
    intrinsic = np.maximum(np.where(call, forward - strike, strike - forward), 0)
    with np.errstate(all="ignore"):
        return np.exp(-rate * years) * (intrinsic + np.sqrt(forward * strike) * time_value(np.abs(np.log(forward / strike)), vol * np.sqrt(years)))


def solve(paid: np.ndarray, forward: np.ndarray, strike: np.ndarray, years: np.ndarray, call: np.ndarray, rate: float = RATE, lowest: float = LOWEST, highest: float = HIGHEST) -> np.ndarray:
    """The volatility that gives the price; NaN where none between lowest and highest does, or an input is unknown or not above 0.

    From a rational first guess, Newton's steps on the deviation; a step out of the
    interval that still holds the answer halves it instead. Rows leave once their
    deviation no longer changes.
    """
    out = np.full(len(paid), np.nan)
    with np.errstate(all="ignore"):
        unit = np.sqrt(forward * strike)
        worth = (paid * np.exp(rate * years) - np.maximum(np.where(call, forward - strike, strike - forward), 0)) / unit
        distance, root = np.abs(np.log(forward / strike)), np.sqrt(years)
        fits = (forward > 0) & (strike > 0) & (years > 0) & (time_value(distance, lowest * root) <= worth) & (worth <= time_value(distance, highest * root)) & (worth > 0)
    rows = np.flatnonzero(fits)
    worth, distance, root = worth[rows], distance[rows], root[rows]
    low, high = lowest * root, highest * root
    middle = worth + (np.exp(distance / 2) - np.exp(-distance / 2)) / 2
    guess = np.sqrt(2 * np.pi) / (np.exp(distance / 2) + np.exp(-distance / 2)) * (middle + np.sqrt(np.maximum(middle**2 - (np.exp(distance / 2) - np.exp(-distance / 2)) ** 2 / np.pi, 0)))
    s = np.clip(guess, low, high)
    while len(rows):
        off = time_value(distance, s) - worth
        low, high = np.where(off < 0, s, low), np.where(off > 0, s, high)
        with np.errstate(all="ignore"):
            step = s - off / _slope(distance, s)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        new = np.where(off == 0, s, new)
        done = np.abs(new - s) <= TOLERANCE * s
        out[rows[done]] = new[done] / root[done]
        rows, worth, distance, root, low, high, s = (x[~done] for x in (rows, worth, distance, root, low, high, new))
    return out


def implied_volatility(paid: Column, forward: Column, strike: Column, years: Column, call: Column, rate: float = RATE, lowest: float = LOWEST, highest: float = HIGHEST) -> Column:
    """`solve` for the rows of an Arrow batch at once; null where there is none."""

    @F.pandas_udf("double")
    def solved(p: pd.Series, f: pd.Series, k: pd.Series, t: pd.Series, c: pd.Series) -> pd.Series:
        own = [x.to_numpy(float, na_value=np.nan) for x in (p, f, k, t)]
        out = solve(*own, c.fillna(False).to_numpy(bool), rate, lowest, highest)
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return solved(paid.cast("double"), forward.cast("double"), strike.cast("double"), years.cast("double"), call)
