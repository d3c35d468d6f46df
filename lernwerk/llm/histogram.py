"""Exact split points of a sorted order, found by counting and not by sorting."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 63


@dataclass
class Split:
    """Where a target weight falls: inside the row (key, tie), before which lie ``below``."""

    target: float
    key: int
    tie: int
    below: int
    weight: int
    group_below: int  # before the first row with this key
    after: bool = False  # the split comes after the row, not before it
    whole: bool = False  # it comes before or after all rows with this key


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def split_points(
    rows: DataFrame, targets: list[float], key: str = "key", tie: str = "tie", weight: str = "weight", bits: int = 9, finish: int = 2000
) -> list[Split]:
    """For every target, the row in (key, tie) order that holds that unit of the running weight.

    ``key`` is a long of at least 0, ``tie`` a long, ``weight`` a long above 0. Each round
    counts exact weights below ``2**bits`` candidate boundaries inside every bracket
    that still holds a target, and keeps the one sub-bracket that the target falls
    in. A bracket with at most ``finish`` rows is read out and settled. Keys held by
    very many rows are refined on ``tie`` in the same way. What comes to the driver
    is bounded by ``len(targets) * max(2**bits, finish)`` rows whatever the input.
    Rows equal in key and tie are not told apart.
    """
    parent, shift = {i: 0 for i in range(len(targets))}, KEY_BITS
    below = {i: 0 for i in parent}
    settle: list[tuple[int, int, int, int | None, int | None]] = []  # target, key from, key to, tie from, tie to
    group_below: dict[int, int] = {}
    by_tie: dict[int, int] = {}
    found: list[Split | None] = [None] * len(targets)
    while parent and shift:
        step = min(bits, shift)
        kept = rows.where(F.shiftright(key, shift).isin(sorted(set(parent.values())))) if shift < KEY_BITS else rows
        counts: dict[int, list[tuple[int, int, int]]] = {}
        for child, w, n in kept.groupBy(F.shiftright(key, shift - step).alias("child")).agg(F.sum(weight), F.count("*")).collect():
            counts.setdefault(child >> step, []).append((child, w, n))
        shift -= step
        for i, p in list(parent.items()):
            for child, w, n in sorted(counts.get(p, [])):
                if below[i] + w > targets[i]:
                    parent[i] = child
                    if n <= finish:
                        settle.append((i, child << shift, ((child + 1) << shift) - 1, None, None))
                        del parent[i]
                    elif not shift:
                        by_tie[i] = child
                        group_below[i] = below[i]
                        del parent[i]
                    break
                below[i] += w
            else:
                del parent[i]  # at or beyond the total: no row holds it
    ties = {i: (k, -(2**63), 2**63 - 1) for i, k in by_tie.items()}
    while ties:
        spans = sorted(set(ties.values()))
        inside = [(F.col(key) == k) & F.col(tie).between(lo, hi) for k, lo, hi in spans]
        number = F.coalesce(*[F.when(c, F.lit(j)) for j, c in enumerate(inside)])
        held = rows.where(_any(inside)).select(number.alias("span"), F.col(tie).alias("t"), F.col(weight).alias("w"))
        ends = {r[0]: (r[1], r[2], r[3]) for r in held.groupBy("span").agg(F.min("t"), F.max("t"), F.count("*")).collect()}
        bucket = F.coalesce(*[F.when(F.col("span") == j, F.floor((F.col("t").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(-(-(hi - lo + 1) >> bits)).cast("decimal(20,0)"))) for j, (lo, hi, _) in ends.items()])
        counts2: dict[int, list[tuple[int, int, int]]] = {}
        for j, b, w, n in held.groupBy("span", bucket.alias("b")).agg(F.sum("w"), F.count("*")).collect():
            counts2.setdefault(j, []).append((int(b), w, n))
        for i, span in list(ties.items()):
            j = spans.index(span)
            lo, hi, _ = ends[j]
            width = -(-(hi - lo + 1) >> bits)
            for b, w, n in sorted(counts2[j]):
                if below[i] + w > targets[i]:
                    span = (span[0], lo + b * width, min(hi, lo + (b + 1) * width - 1))
                    if n <= finish or span[1] == span[2]:
                        if n <= finish:
                            settle.append((i, span[0], span[0], span[1], span[2]))
                        else:
                            found[i] = Split(targets[i], span[0], span[1], below[i], w, group_below[i])
                        del ties[i]
                    else:
                        ties[i] = span
                    break
                below[i] += w
    if settle:
        spans4 = sorted({s[1:] for s in settle}, key=str)
        inside = [F.col(key).between(a, b) & (F.col(tie).between(c, d) if c is not None else F.lit(True)) for a, b, c, d in spans4]
        read = rows.where(_any(inside)).groupBy(F.col(key).alias("k"), F.col(tie).alias("t")).agg(F.sum(weight).alias("w")).collect()
        read = sorted((r[0], r[1], r[2]) for r in read)
        for i, a, b, c, d in settle:
            at, start, last = below[i], group_below.get(i, below[i]), None
            for k, t, w in read:
                if not (a <= k <= b and (c is None or c <= t <= d)):
                    continue
                if k != last and c is None:
                    start = at
                last = k
                if at + w > targets[i]:
                    found[i] = Split(targets[i], k, t, at, w, start)
                    break
                at += w
    return [f for f in found if f]
