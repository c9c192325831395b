"""A counter-based generator as a Column: draw i is a function of the seed and i alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator (mulberry32).
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _times(x: Column, y: Column) -> Column:
    """The low 32 bits of a product, without overflow of 64 bits."""
    high = F.shiftright(x, 16) * y
    return ((high.bitwiseAND(0xFFFF)) * 65536 + x.bitwiseAND(0xFFFF) * y).bitwiseAND(MASK)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def uniform(seed: int, position: Column) -> Column:
    """The draw in [0, 1) at each 0-based position."""
    start = (int(seed) & MASK) or 1
    i = position.cast("bigint") + 1
    a = (_times(i.bitwiseAND(MASK), F.lit(STEP)) + start).bitwiseAND(MASK)
    first = lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    second = lambda t: (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(MASK).bitwiseXOR(t)
    return _let(_let(_let(a, first), second), lambda u: u.bitwiseXOR(F.shiftright(u, 14))) / F.lit(4294967296.0)


def draws(seed: int, n: int) -> np.ndarray:
    """The first ``n`` draws, as numbers."""
    i = np.arange(1, n + 1, dtype=np.uint64)
    mask = np.uint64(MASK)
    a = (np.uint64((int(seed) & MASK) or 1) + i * np.uint64(STEP)) & mask
    t = (a ^ (a >> np.uint64(15))) * (a | np.uint64(1)) & mask
    u = (t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & mask)) & mask ^ t
    return (u ^ (u >> np.uint64(14))).astype(float) / 4294967296.0
