"""Pseudo-random orders of 0 ... n - 1 that can be computed position by position: a Feistel network on the least even number
of bits that holds n, applied again while the result is n or more."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, PRIME, FACTOR, SHIFT = 4, 2_147_483_647, 48_271, 3
#: Positions that are computed at once.
SLICE = 1 << 20


def half_bits(n: int) -> int:
    h = 1
    while 1 << 2 * h < n:
        h += 1
    return h


def permuted(index: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The position of each index (0 to n - 1) in the order that its row of ROUNDS keys fixes; every order is a bijection."""
    h = half_bits(n)
    mask, out, open_ = (1 << h) - 1, index.astype(np.int64), np.arange(len(index))
    while len(open_):
        x, k = out[open_], keys[open_]
        left, right = x >> h, x & mask
        for t in range(ROUNDS):
            y = (right * FACTOR + k[:, t]) % PRIME
            left, right = right, left ^ (y * y % PRIME >> SHIFT & mask)
        x = left << h | right
        out[open_] = x
        open_ = open_[x >= n]
    return out


def keys(seed: int, key: Column) -> Column:
    """ROUNDS numbers of 28 bits that seed and key fix, as an array."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.array(*(F.conv(F.substring(digest, 7 * k + 1, 7), 16, 10).cast("bigint") for k in range(ROUNDS)))


def first_positions(key: Column, count: Column, n: Column) -> Column:
    """ARRAY<BIGINT>: the first count positions in the order of 0 ... n - 1 that the keys fix (count at most n)."""

    def run(key: pd.Series, count: pd.Series, n: pd.Series) -> pd.Series:
        out, begin, counts = [], 0, count.to_numpy(np.int64)
        ends = np.cumsum(counts)
        while begin < len(counts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            some = counts[begin:end]
            row = np.repeat(np.arange(len(some)), some)
            index = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
            found = permuted(index, np.stack(key.iloc[begin:end])[row], int(n.iloc[begin])) if len(row) else index
            out += np.split(found, np.cumsum(some)[:-1])
            begin = end
        return pd.Series(out)

    return F.pandas_udf(run, "array<bigint>")(key, count, n)


def walk_sql(scenarios: str, count: str, seed: int) -> str:
    """The same as common table expressions of DuckDB: shape (n, h) and drawn_at (query_id, draw, position), from a table
    numbered of n rows and one of scenarios (query_id, n_own); count: SQL for the number of draws of each."""
    number = lambda k: f"('0x' || md5('{seed}:' || query_id)[{7 * k + 1}:{7 * k + 7}])::BIGINT"
    y = f"((r * {FACTOR} + k[t % {ROUNDS} + 1]) % {PRIME})"
    return f"""shape AS (SELECT n, (SELECT min(b) FROM range(1, 31) x(b) WHERE 1::BIGINT << (2 * b)::INT >= n)::INT AS h FROM (SELECT count(*) AS n FROM numbered)),
walk AS (SELECT query_id, draw, draw >> h AS l, draw & ((1::BIGINT << h) - 1) AS r, 0 AS t, [{', '.join(map(number, range(ROUNDS)))}] AS k, n, h FROM {scenarios} CROSS JOIN shape, LATERAL (SELECT unnest(range(0, least(n, {count}))) AS draw)
  UNION ALL SELECT query_id, draw, r, xor(l, ({y} * {y} % {PRIME} >> {SHIFT}) & ((1::BIGINT << h) - 1)), t + 1, k, n, h FROM walk WHERE t % {ROUNDS} <> 0 OR t = 0 OR (l << h) + r >= n),
drawn_at AS (SELECT query_id, draw, (l << h) + r AS position FROM walk WHERE t > 0 AND t % {ROUNDS} = 0 AND (l << h) + r < n)"""
