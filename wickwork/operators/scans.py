"""Recurrences over long series, in blocks of candles.

A recurrence takes the value after a candle from the value before it. Two kinds compose, so that a block of candles is one
map, whatever value comes in: affine steps (x' = a x + b) compose to an affine map, and hold steps (x stays inside a band,
else it is reset) to a step function around an interval that passes through. ``run`` folds the maps of every block in
tasks of their own, carries values over the few maps of each series, and gives each block its first value. No task
holds more than a block of candles, and the blocks of one series are worked on side by side.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.functions.staging import staged
from wickwork.schema import SERIES


@dataclass(frozen=True)
class Affine:
    """x' = a x + b; ``a`` 0 starts anew, a null in either leaves x as it is (nothing, before the first start)."""

    a: Column
    b: Column

    def columns(self) -> tuple[Column, ...]:
        return self.a, self.b


@dataclass(frozen=True)
class Hold:
    """x' = x where low <= x <= high, else ``reset``; an empty band starts anew, a null in any leaves x as it is."""

    low: Column
    high: Column
    reset: Column

    def columns(self) -> tuple[Column, ...]:
        return self.low, self.high, self.reset


class AffineMap:
    """The composition of affine steps."""

    @staticmethod
    def folded(a, b) -> dict:
        m, k, seen = 1.0, 0.0, False
        for x, y in zip(a, b, strict=True):
            if x is not None:
                m, k, seen = (0.0, y, True) if x == 0 else (x * m, x * k + y, True)
        return {"scale": m, "shift": k, "seen": seen}

    @staticmethod
    def after(x, row) -> float | None:
        if not row["seen"]:
            return x
        return row["shift"] if row["scale"] == 0 else None if x is None else row["scale"] * x + row["shift"]

    @staticmethod
    def values(x, a, b) -> list:
        out = []
        for p, q in zip(a, b, strict=True):
            if p is not None:
                x = q if p == 0 else None if x is None else p * x + q
            out.append(x)
        return out


class HoldMap:
    """The composition of hold steps: what comes in passes through an interval; outside, the first band that it leaves
    decides on the value at the end. Only bands that narrow the interval can be the first."""

    @staticmethod
    def folded(low, high, reset) -> dict:
        lo, hi, lows, highs = float("-inf"), float("inf"), [], []
        held: list[float] = []  # distinct values that resets of this block have now, ascending
        came: dict[float, list[int]] = {}  # the steps whose reset has that value now
        for i, (a, b, r) in enumerate(zip(low, high, reset, strict=True)):
            if a is None:
                continue
            left = held[: bisect_left(held, a)] + held[bisect_right(held, b) :] if a <= b else list(held)
            steps = []
            if lo <= hi and (a > lo or b < hi):
                if a > lo:
                    lo = a
                    lows.append((a, i))
                if b < hi:
                    hi = b
                    highs.append((b, i))
                steps.append(i)
            for v in left:
                steps += came.pop(v)
                held.pop(bisect_left(held, v))
            if steps:
                if r not in came:
                    insort(held, r)
                came.setdefault(r, []).extend(steps)
        end = {i: v for v, steps in came.items() for i in steps}
        pick = lambda rows: {"at": [v for v, _ in rows], "step": [i for _, i in rows], "end": [end[i] for _, i in rows]}
        return {"lows": pick(lows), "highs": pick(highs)}

    @staticmethod
    def after(x, row) -> float | None:
        lows, highs = row["lows"], row["highs"]
        if x is None:  # only an empty band starts a value
            return next((e for v, e in zip(lows["at"], lows["end"], strict=True) if v == float("inf")), None)
        found = []
        k = bisect_right(lows["at"], x)
        if k < len(lows["at"]):
            found.append((lows["step"][k], lows["end"][k]))
        k = bisect_right([-v for v in highs["at"]], -x)
        if k < len(highs["at"]):
            found.append((highs["step"][k], highs["end"][k]))
        return min(found)[1] if found else x

    @staticmethod
    def values(x, low, high, reset) -> list:
        out = []
        for a, b, r in zip(low, high, reset, strict=True):
            if a is not None and (x is None or not a <= x <= b):
                x = r if x is not None or a > b else None
            out.append(x)
        return out


_MAPS = {Affine: AffineMap, Hold: HoldMap}
_RECORDS = "struct<at:array<double>,step:array<int>,end:array<double>>"


def run(rows: DataFrame, steps: dict[str, Affine | Hold], block: int) -> DataFrame:
    """``rows`` (series, rn, ...) with one double column a step: its value after each candle."""
    import pyarrow as pa

    kinds = {name: _MAPS[type(s)] for name, s in steps.items()}
    args = {name: [f"_{name}_{k}" for k in range(len(s.columns()))] for name, s in steps.items()}
    made = {}
    for name, s in steps.items():
        known = reduce(and_, (c.isNotNull() for c in s.columns()))
        made |= {c: F.when(known, x.cast("double")) for c, x in zip(args[name], s.columns(), strict=True)}
    work = staged(rows.withColumns(made).withColumn("_block", F.floor((F.col("rn") - 1) / block).cast("bigint")), "steps")
    keys, types = [*SERIES, "_block"], {f.name: f.dataType.simpleString() for f in work.schema.fields}
    named = ", ".join(f"{k} {types[k]}" for k in keys)
    nothing = {"at": [], "step": [], "end": []}

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        out = []
        for name, kind in kinds.items():
            m = kind.folded(*(t.column(c).to_pylist() for c in args[name]))
            out.append({"name": name, "scale": m.get("scale"), "shift": m.get("shift"), "seen": m.get("seen"), "lows": m.get("lows", nothing), "highs": m.get("highs", nothing)})
        table = pa.Table.from_pylist(out, schema=maps)
        for at, k in enumerate(keys):
            table = table.add_column(at, k, pa.array([t.column(k)[0].as_py()] * len(out), t.schema.field(k).type))
        return table

    record = pa.struct([("at", pa.list_(pa.float64())), ("step", pa.list_(pa.int32())), ("end", pa.list_(pa.float64()))])
    maps = pa.schema([("name", pa.string()), ("scale", pa.float64()), ("shift", pa.float64()), ("seen", pa.bool_()), ("lows", record), ("highs", record)])
    wanted = [*keys, "rn", *(c for cs in args.values() for c in cs)]
    folded = work.select(*wanted).groupBy(*keys).applyInArrow(fold, f"{named}, name string, scale double, shift double, seen boolean, lows {_RECORDS}, highs {_RECORDS}")

    def carry(t: pa.Table) -> pa.Table:
        last: dict[str, float | None] = {}
        first = []
        for r in t.sort_by("_block").to_pylist():
            first.append(last.get(r["name"]))
            last[r["name"]] = kinds[r["name"]].after(first[-1], r)
        t = t.sort_by("_block")
        return t.select([*keys, "name"]).append_column("first", pa.array(first, pa.float64()))

    first = folded.groupBy(*SERIES).applyInArrow(carry, f"{named}, name string, first double")

    def apply(t: pa.Table, start: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        known = dict(zip(start.column("name").to_pylist(), start.column("first").to_pylist(), strict=True))
        for name, kind in kinds.items():
            t = t.append_column(name, pa.array(kind.values(known.get(name), *(t.column(c).to_pylist() for c in args[name])), pa.float64()))
        return t

    fields = ", ".join(f"`{k}` {v}" for k, v in types.items()) + "".join(f", `{name}` double" for name in steps)
    out = work.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(apply, fields)
    return out.drop("_block", *(c for cs in args.values() for c in cs))
