"""Filling containers of fixed capacity: a configuration linear program over the histogram of sizes.

The histogram, at most one row per size up to the capacity, is all that reaches the driver. There multiplicative weights
price all sizes, dynamic programming over the capacity finds the patterns of greatest worth and a bound from below, and
patterns are taken a whole number of times. What is left is too thin for that and goes, by weights again, into patterns
over the sizes of greatest weight, and at last first-fit by decreasing size. Where that leaves room, the covering program
over all patterns is solved by column generation and rounded down. The plan assigns runs of ranks within a size to
containers, so that each item finds its container by its own rank alone, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: rounds of column generation times sizes
WORK = 400_000


def price(worth: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of sizes of greatest total worth within capacity, of each at most its limit, by dynamic programming."""
    lots: list[tuple[int, int]] = []  # a limit n as lots of 1, 2, 4, ... and a rest, each taken or not
    for k in np.flatnonzero(most > 0).tolist():
        n, lot = min(int(most[k]), capacity // int(sizes[k])), 1
        while n > 0:
            lot = min(lot, n)
            lots.append((k, lot))
            n -= lot
            lot *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(lots), capacity + 1), bool)
    for i, (k, lot) in enumerate(lots):
        s = int(sizes[k]) * lot
        if s <= capacity:
            other = best[: capacity + 1 - s] + worth[k] * lot
            np.greater(other, best[s:], out=taken[i, s:])
            best[s:] = np.maximum(best[s:], other)
    out: dict[int, int] = {}
    c = capacity
    for i in range(len(lots) - 1, -1, -1):
        if taken[i, c]:
            k, lot = lots[i]
            out[k] = out.get(k, 0) + lot
            c -= int(sizes[k]) * lot
    return out


def table(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(greatest worth, last size taken or -1) for every room up to capacity, each size as often as it fits; sizes ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        j = fits[c]
        if j:
            values = best[c - sizes[:j]] + worth[:j]
            k = int(values.argmax())
            if values[k] > best[c]:
                best[c], taken[c] = values[k], k
    return best, taken


def multiplicative(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 120, rate: float = 0.2, slack: float = 0.004, step: float = 0.1) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Patterns and how often each is taken, and a bound from below on the containers, by multiplicative weights.

    A round prices every size of the histogram by its weight, exp(rate * share of its items still to be placed), times its
    size and a little more for large ones, which are the harder to place. Dynamic programming over all sizes gives the
    greatest worth of a container, and for each size the best pattern that holds it; those within slack of the greatest
    worth are taken, until a round's share of all containers is filled. Weights fall as items are placed, so the sizes are
    used up alike. Prices are shaken by less than slack, for patterns to differ from round to round. The prices divided by the greatest worth solve the dual, whose value is the bound. It ends when five
    rounds found no pattern, as the counts of the sizes that fill up containers are used up, or after so many rounds.
    """
    out: list[tuple[dict[int, int], int]] = []
    left = counts.copy()
    prior = sizes * (sizes / capacity) ** 0.05
    least, idle = float((sizes * counts).sum()) / capacity, 0
    jitter = np.random.default_rng(0)
    for r in range(rounds):
        alive = np.flatnonzero(left)
        if not len(alive) or idle == 5:
            break
        worth = prior[alive] * np.exp(rate * (left[alive] / counts[alive] - 1)) * jitter.uniform(1 - slack, 1, len(alive))
        best, taken = table(worth, sizes[alive], capacity)
        least = max(least, float((worth * counts[alive]).sum()) / best[capacity])
        quota = max(1, int(np.ceil((sizes * left).sum() / capacity / (rounds - r))))
        most = np.minimum(left, np.ceil(step * counts).astype(np.int64))  # what a round may use of a size
        filled = 0
        values = worth + best[capacity - sizes[alive]]
        for k in np.argsort(-values, kind="stable"):
            if values[k] < (1 - slack) * best[capacity] or filled >= quota:
                break
            pattern, c = {int(alive[k]): 1}, capacity - int(sizes[alive[k]])
            while c > 0:
                if taken[c] < 0:
                    c -= 1
                    continue
                i = int(alive[taken[c]])
                pattern[i] = pattern.get(i, 0) + 1
                c -= int(sizes[i])
            times = min(quota - filled, *(int(most[i]) // n for i, n in pattern.items()))
            if times > 0 and sum(int(sizes[i]) * n for i, n in pattern.items()) >= (1 - slack) * capacity:
                for i, n in pattern.items():
                    left[i] -= n * times
                    most[i] -= n * times
                out.append((pattern, times))
                filled += times
        idle = 0 if filled else idle + 1
    return out, least


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, candidates: int = 96, tries: int = 20) -> list[tuple[dict[int, int], int]]:
    """Patterns and their numbers, which cover no size more than its count, by multiplicative weights.

    A size's weight falls exponentially with the share of its items that is covered; larger sizes weigh more than in
    proportion, as they are the harder ones to place. A round prices a pattern over the sizes of greatest weight and
    takes it as often as their items allow, up to a share of all containers; half of these sizes are drawn from those of
    at most half a container. So all sizes are used up alike, and what is left at any time is mixed as the whole was.
    A pattern less full than the level asked for is taken only if no other draw of sizes gives a fuller one: after so many
    tries the fullest of them is taken, and its fill is the level from then on.
    """
    out: list[tuple[dict[int, int], int]] = []
    left = counts.copy()
    share = max(1, round(8 * float((sizes * counts).sum()) / capacity / max(1, rounds)))
    jitter = np.random.default_rng(0)
    level, failed, fullest = 0.9995 * capacity, 0, (0, {})
    for _ in range(rounds):
        alive = np.flatnonzero(left >= 1)
        if not len(alive):
            break
        top = alive
        if len(alive) > candidates:
            weight = np.exp(-(1 - left[alive] / counts[alive]))
            top = alive[np.argsort(-weight * jitter.uniform(0.6, 1, len(alive)))[: candidates // 2]]
            small = alive[sizes[alive] * 2 <= capacity]
            top = np.union1d(top, small[jitter.permutation(len(small))[: candidates // 2]])
        worth = np.zeros(len(sizes))
        worth[top] = sizes[top] * (sizes[top] / capacity) ** 0.05 * np.exp(-(1 - left[top] / counts[top]))
        most = np.zeros(len(sizes), np.int64)
        most[top] = np.maximum(1, left[top] // 4)
        pattern = price(worth, sizes, most, capacity)
        used = sum(int(sizes[k]) * n for k, n in pattern.items())
        if used < level and len(alive) > candidates:
            failed += 1
            fullest = max(fullest, (used, pattern), key=lambda f: f[0])
            if failed <= tries:
                continue
            level, pattern = fullest
        failed, fullest = 0, (0, {})
        x = min(share, *(int(left[k]) // n for k, n in pattern.items()))
        for k, n in pattern.items():
            left[k] -= n * x
        out.append((pattern, x))
    return out


def covering(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The covering program over all patterns: patterns and their fractional numbers, and the least number of containers.

    A basis of one pattern a size starts with each size alone; its prices go to the dynamic program, and the pattern of
    greatest worth enters. Prices divided by that worth are a solution of the dual, so they bound the containers from
    below: it ends when the bound, rounded up, reaches the program's value, when 200 rounds brought nothing, or after so many
    rounds, the fewer the more sizes there are, with the bound so far.
    """
    m = len(sizes)
    most = np.minimum(counts, capacity // sizes)
    patterns: list[dict[int, int]] = [{k: int(most[k])} for k in range(m)]
    inverse = np.diag(1 / most.astype(float))
    x = counts / most
    least, value, since = float((sizes * counts).sum()) / capacity, np.inf, 0
    for i in range(min(rounds, max(200, WORK // m))):
        since = 0 if x.sum() < value * (1 - 1e-7) else since + 1
        value = min(value, float(x.sum()))
        if since > 200:
            break
        if i % 500 == 499:  # rounding errors of the updates: what the numbers leave of the counts is solved for once more
            rest = counts.astype(float)
            for p, n in zip(patterns, x.tolist()):
                for k, many in p.items():
                    rest[k] -= many * n
            x = np.maximum(0, x + (inverse * rest).sum(axis=1))
        y = np.maximum(0, inverse.sum(axis=0))
        pattern = price(y, sizes, most, capacity)
        worth = sum(float(y[k]) * n for k, n in pattern.items())
        least = max(least, float((y * counts).sum()) / max(1.0, worth))
        if worth <= 1 + 1e-9 or np.ceil(least - 1e-6) >= np.ceil(x.sum() - 1e-6):
            break
        d = (inverse[:, list(pattern)] * np.array(list(pattern.values()), float)).sum(axis=1)  # no threads of a linear algebra library
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        j = int(np.argmin(ratio))
        step = ratio[j]
        x = np.maximum(0, x - step * d)
        x[j] = step
        row = inverse[j] / d[j]
        inverse -= np.outer(d, row)
        inverse[j] = row
        patterns[j] = pattern
    return list(zip(patterns, x.tolist(), strict=True)), least


@dataclass
class Plan:
    """Runs of ranks: items of size s with ranks from start go, per of them, to containers from base on.

    method names what made it, least is the number of containers below which no plan can go, first_fit what first-fit
    by decreasing size alone would need.
    """

    size: np.ndarray
    start: np.ndarray
    per: np.ndarray
    base: np.ndarray
    containers: int
    capacity: int
    used: int
    method: str = ""
    least: float = 0.0
    first_fit: int = 0

    @property
    def fill(self) -> float:
        return self.used / (self.containers * self.capacity) if self.containers else 1.0


def plan(histogram: list[tuple[int, int]], capacity: int, rounds: int = 4000, enough: float = 0.999) -> Plan:
    """The plan for a histogram of (size, count) with sizes from 1 to capacity: the one of fewest containers among these.

    By multiplicative weights over all sizes, then over those left; by first-fit alone; and, unless the bound shows that the
    share that is enough of their containers is needed anyhow, by column generation, rounded down. The plan tells which.
    """
    pairs = sorted((s, n) for s, n in histogram if s > 0 and n > 0)
    if any(s > capacity for s, _ in pairs):
        raise ValueError("an item is larger than a container")
    sizes, counts = np.array([s for s, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)
    if not pairs:
        return _plan(sizes, counts, capacity, [], 0, "nothing to place")
    start, least = multiplicative(sizes, counts, capacity)
    first = _plan(sizes, counts, capacity, [], 0, "first-fit decreasing")
    best = min((_plan(sizes, counts, capacity, start, rounds, "multiplicative weights"), first), key=lambda p: p.containers)
    least = max(least, int(counts[sizes * 2 > capacity].sum()))  # no two above half a container go together
    if best.containers * enough > np.ceil(least - 1e-6):
        start, more = covering(sizes, counts, capacity, rounds)
        least = max(least, more)
        if best.containers > np.ceil(least - 1e-6):
            best = min((best, *(_plan(sizes, counts, capacity, start, r, "column generation") for r in (rounds, 0))), key=lambda p: p.containers)
    best.least, best.first_fit = float(np.ceil(least - 1e-6)), first.containers
    return best


def _plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, start: list[tuple[dict[int, int], float]], rounds: int, method: str = "") -> Plan:
    """The patterns of start, rounded down; of the rest those of multiplicative weights; of the rest first-fit by decreasing size."""
    runs: list[tuple[int, int, int, int]] = []
    left = counts.copy()
    base = 0

    def put(pattern: dict[int, int], times: int) -> None:
        nonlocal base
        for k, n in pattern.items():
            runs.append((int(sizes[k]), int(counts[k] - left[k]), n, base))
            left[k] -= n * times
        base += times

    def fit(patterns: list[tuple[dict[int, int], float]]) -> None:
        for pattern, x in patterns:
            times = min(int(x + 1e-6), *(int(left[k]) // n for k, n in pattern.items()))
            if times > 0:
                put(pattern, times)

    if len(sizes):
        fit(start)
        some = np.flatnonzero(left)
        fit([({int(some[k]): n for k, n in pattern.items()}, x) for pattern, x in fractional(sizes[some], left[some], capacity, rounds)])
        alive = [k for k in range(len(sizes)) if left[k] > 0]  # ascending by size
        while alive:
            room, pattern, have = capacity, {}, {}
            hi = len(alive)
            while hi > 0:
                hi = min(hi, int(np.searchsorted(sizes[alive[:hi]], room, side="right")))
                if hi == 0:
                    break
                k = alive[hi - 1]
                n = min(int(left[k]), room // int(sizes[k]))
                pattern[k], have[k] = n, int(left[k])
                room -= n * int(sizes[k])
                hi -= 1
            put(pattern, min(have[k] // n for k, n in pattern.items()))
            alive = [k for k in alive if left[k] > 0]
    order = sorted(runs)
    cols = [np.array(c, np.int64) for c in zip(*order)] if order else [np.zeros(0, np.int64)] * 4
    return Plan(*cols, containers=base, capacity=capacity, used=int((sizes * counts).sum()), method=method)


def items_of(sized: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, size): one row per item; only one larger than capacity is split, into full pieces and a rest."""
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / F.lit(capacity)).cast("int"))))
    return sized.select(F.col(f"`{key}`"), pieces.alias("piece"), F.col("size").alias("__all")).select(key, "piece", F.least(F.lit(capacity), F.col("__all") - F.col("piece") * capacity).cast("int").alias("size"))


def histogram(items: DataFrame) -> list[tuple[int, int]]:
    """(size, count) of items: at most capacity + 1 rows."""
    return [(r[0], r[1]) for r in items.groupBy("size").count().collect()]


def fill(sized: DataFrame, key: str, capacity: int, rounds: int = 4000, group: int = 50_000) -> tuple[DataFrame, Plan]:
    """((key, piece, size, container) of every item, the plan) for rows (key, size).

    A null or negative size counts as 0; items of size 0 take no room and are spread over all containers (container 0
    where there is none). Repeated rows are items of their own. sized is read twice and must not change in between:
    pass a written table. group: about how many items of a size one task ranks; a size that a third of all items has
    is ranked in many groups.
    """
    spark = sized.sparkSession
    items = items_of(sized.select(F.col(f"`{key}`"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("size")), key, capacity)
    counts = histogram(items)
    p = plan(counts, capacity, rounds)
    groups = max(1, max((n for _, n in counts), default=0) // group)
    salted = items.withColumn("__g", F.pmod(F.xxhash64(key, "piece"), F.lit(groups)).cast("int"))
    before = salted.groupBy("size", "__g").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("size").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("size", "__g").orderBy(key, "piece")) - 1)
    if groups > 1:
        ranked = ranked.join(before.select("size", "__g", "__before"), ["size", "__g"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = ranked.select(key, "piece", "size", F.col("__rank").cast("long").alias("rank"))
    schema = ranked.select(key, "piece", "size").schema.add("container", "long")
    shared = spark.sparkContext.broadcast((p.size, p.start, p.per, p.base, p.containers))  # at most a few runs a size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, start, per, base, containers = shared.value
        wide = np.int64(2**40)
        keys = size * wide + start
        for b in batches:
            s, r = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, s * wide + r, side="right") - 1
            none = s == 0
            at = np.where(none, 0, at)
            c = base[at] + (r - start[at]) // per[at] if len(keys) else np.zeros(len(s), np.int64)
            c = np.where(none, r % max(1, containers), c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(c, pa.int64())], names=[f.name for f in schema])

    return ranked.mapInArrow(place, schema), p
