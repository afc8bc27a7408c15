"""Filling containers of fixed capacity with items of varying length, by exact complements.

Only lengths matter, so the plan is made on the histogram of lengths: at most `capacity` numbers, whatever the
corpus. Lengths are taken from the longest down. The gap a container has left is closed exactly where a single
length, a pair or a triple of lengths still available sums to it (indexes of pair sums and lengths); where none
does, the longest length that fits goes in and the search goes on (best fit). A combination is then used as often
as its lengths allow, so every step exhausts a length and the plan stays as small as the histogram.

The items follow the plan without being collected: each gets its rank among the items of its length (counted in
salted groups, so a length that a third of all items share is no single task), and rank ranges map to containers.
Broadcast: the plan's rank ranges, bounded by the capacity (see `MAX_RANGES`, checked).

Defined results: items of zero length (null or empty texts) are in no container; an item longer than the capacity
is cut into full containers and one rest, which is packed like any item; no other item is split. Ties among items
of equal length go by id. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.session import written

MAX_PROFILES = 64
MAX_RANGES = 5_000_000
#: Items per salted group when ranks are counted.
GROUP_ROWS = 200_000


class _Stock:
    """Available counts by length with the indexes of sums."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.capacity = len(counts) - 1
        self.stale = 0
        self._index()

    def _index(self) -> None:
        """Which sums a pair of available lengths has."""
        size = 2 * (self.capacity + 1)
        have = np.zeros(size)
        have[: self.capacity + 1] = self.n > 0
        f = np.fft.rfft(have)
        self.pairs = np.fft.irfft(f * f, size)[: self.capacity + 1] > 0.5
        self.stale = 0

    def take(self, lengths: np.ndarray, times: np.ndarray) -> None:
        self.n[lengths] -= times
        if (self.n[lengths] == 0).any():
            self.stale += 1
            if self.stale >= 64:
                self._index()

    def _pair(self, gap: int, free: np.ndarray) -> tuple[int, int] | None:
        half = gap // 2
        a = np.arange(1, half + 1)
        ok = (free[1 : half + 1] > 0) & (free[gap - a] > 0)
        if gap % 2 == 0 and half and free[half] < 2:
            ok[half - 1] = False
        at = np.flatnonzero(ok)
        return (gap - int(a[at[0]]), int(a[at[0]])) if len(at) else None

    def exact(self, gap: int, free: np.ndarray) -> list[int] | None:
        """Lengths, at most three, that sum to the gap; free: counts not yet used by the container in hand."""
        if free[gap] > 0:
            return [gap]
        if not self.pairs[gap] and self.stale == 0:
            pair = None
        else:
            pair = self._pair(gap, free)
        if pair:
            return list(pair)
        first = np.arange(gap - 2, 0, -1)
        for a in first[(free[first] > 0) & self.pairs[gap - first]]:  # the index may be older than the stock
            free[a] -= 1
            pair = self._pair(gap - int(a), free)
            free[a] += 1
            if pair:
                return [int(a), *pair]
        return None


@dataclass
class Plan:
    """Rank ranges: position start[i].. in the order (length, rank) goes to containers base[i], `each` items a time."""

    offsets: np.ndarray
    start: np.ndarray
    base: np.ndarray
    each: np.ndarray
    unused: np.ndarray
    containers: int


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    """counts[l]: items of length l, for l in 0..capacity (0 is ignored)."""
    n = counts.astype(np.int64).copy()
    n[0] = 0
    offsets = np.concatenate(([0], np.cumsum(n)))[: capacity + 1]
    stock, used_rank = _Stock(n), np.zeros(capacity + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int]] = []
    containers = 0
    for length in range(capacity, 0, -1):
        while n[length] > 0:
            free = n.copy()
            free[length] -= 1
            content, gap = {length: 1}, capacity - length
            while gap > 0:
                more = stock.exact(gap, free)
                if more is None:
                    fits = np.flatnonzero(free[1 : gap + 1] > 0)
                    if not len(fits):
                        break
                    more = [int(fits[-1]) + 1]
                for x in more:
                    content[x] = content.get(x, 0) + 1
                    free[x] -= 1
                    gap -= x
            lengths, times = np.fromiter(content, np.int64), np.fromiter(content.values(), np.int64)
            repeat = int((n[lengths] // times).min())
            for x, t in content.items():
                rows.append((int(offsets[x] + used_rank[x]), containers, t, gap))
                used_rank[x] += repeat * t
            stock.take(lengths, times * repeat)
            containers += repeat
    if len(rows) > MAX_RANGES:
        raise ValueError("the plan is larger than its bound")
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(offsets, table[:, 0], table[:, 1], table[:, 2], table[:, 3], containers)


def pack(items: DataFrame, profiles: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(profile, container_id, key, piece, n_tokens, capacity_tokens, unused_tokens): the contents of each container.

    items: key and size, one row per item; profiles: profile, capacity_tokens (at most MAX_PROFILES, each positive).
    """
    named = [(r["profile"], int(r["capacity_tokens"])) for r in profiles.select("profile", "capacity_tokens").dropna().distinct().orderBy("profile", "capacity_tokens").limit(MAX_PROFILES + 1).collect()]
    if len(named) > MAX_PROFILES or any(c < 1 for _, c in named):
        raise ValueError("too many profiles, or one without capacity")
    kind = dict(items.dtypes)[key]
    base = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")).filter("n > 0")
    choices = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(c).cast("long").alias("c")) for i, (_, c) in enumerate(named)]) if named else F.array().cast("array<struct<p:int,c:bigint>>")
    each = base.select("key", "n", F.explode(choices).alias("x")).select("key", "n", "x.p", "x.c")
    pieces = each.select("key", "p", "c", F.col("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div c"))).alias("piece")).select("key", "p", "c", "piece", F.least("c", F.col("n") - F.col("piece") * F.col("c")).alias("len"))
    pieces = written(pieces, "pieces")

    sums = pieces.groupBy("p", "len").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most capacity rows a profile
    plans = []
    for i, (_, c) in enumerate(named):
        own, counts = sums[sums["p"] == i], np.zeros(c + 1, dtype=np.int64)
        counts[own["len"].to_numpy(dtype=np.int64)] = own["n"].to_numpy(dtype=np.int64)
        plans.append(make_plan(counts, c))
    salts = max(8, math.ceil(float(sums["n"].max() if len(sums) else 0) / GROUP_ROWS))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("p", "len", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = groups.selectExpr("p", "len", "salt", "sum(m) OVER (PARTITION BY p, len ORDER BY salt) - m AS before")
    ranked = salted.selectExpr("*", "row_number() OVER (PARTITION BY p, len, salt ORDER BY key, piece) - 1 AS inner_rank").join(before, ["p", "len", "salt"]).withColumn("rank", F.col("before") + F.col("inner_rank"))

    shared = pieces.sparkSession.sparkContext.broadcast(plans)

    def place(p: pd.Series, length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        container, unused = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
        ps, ls, rs = p.to_numpy(), length.to_numpy(), rank.to_numpy()
        for i, plan in enumerate(shared.value):
            at = np.flatnonzero(ps == i)
            if len(at):
                position = plan.offsets[ls[at]] + rs[at]
                row = np.searchsorted(plan.start, position, side="right") - 1
                container[at] = plan.base[row] + (position - plan.start[row]) // plan.each[row]
                unused[at] = plan.unused[row]
        return pd.DataFrame({"container": container, "unused": unused})

    result = T.StructType([T.StructField("container", T.LongType()), T.StructField("unused", T.LongType())])
    udf = F.pandas_udf(_typed(place), result)
    names = F.array(*[F.lit(x) for x, _ in named]) if named else F.array().cast("array<string>")
    placed = ranked.withColumn("x", udf("p", "len", "rank"))
    return placed.select(F.get(names, F.col("p")).alias("profile"), F.col("x.container").alias("container_id"), F.col("key").cast(kind).alias(key), "piece", F.col("len").alias("n_tokens"), F.col("c").alias("capacity_tokens"), F.col("x.unused").alias("unused_tokens"))


def _typed(f):
    """Real annotations in place of the postponed ones, which the UDF machinery reads."""
    f.__annotations__ = {"p": pd.Series, "length": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    return f


def packing_summary(contents: DataFrame) -> DataFrame:
    """Per profile: containers, pieces, tokens, unused tokens and the filled share."""
    per = contents.groupBy("profile", "container_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("c"), F.max("unused_tokens").alias("u"))
    tot = per.groupBy("profile").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.sum("u").alias("unused_tokens"), F.sum("c").alias("_c"))
    return tot.select("profile", "n_containers", "n_pieces", "n_tokens", "unused_tokens", F.try_divide(F.col("n_tokens").cast("double"), F.col("_c")).alias("filled"))
