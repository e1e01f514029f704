"""Exact linear-interpolated quantiles by repeated selection.

A wanted rank lies in an open interval of values, at first the whole line.
Each round draws a few cut values inside the interval from an approximate
sketch, counts exactly how many rows lie between and on the cuts, and keeps
the piece that holds the rank. A rank on a cut is settled at once, so a value
holding a third of all rows ends its search in the first round. Intervals
that hold few rows are read in one last aggregate.

The sketch only chooses where to cut: what is returned is the value at the
exact rank, the same for every partitioning. Cuts are values of the interval,
so every round takes at least one distinct value out of it, and usually all
but about a six-hundredth. Rounds filter on the intervals, which Parquet
prunes by its statistics. No value is ranked by a window, and what reaches
the driver is bounded by the number of ranks and by ``hold``.

Tables of ``(column, num, cnt)`` rows are searched in the same way, with
weighted counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "column string, p_index int, prob double, value double"
# rows that all last intervals together may hold
HOLD = 200_000
# evenly spaced cuts of an interval of distinct values
PARTS = 16


class Interval(NamedTuple):
    """Open interval of the values of a column; ``None`` is unbounded."""

    column: str
    low: float | None
    high: float | None


class Search(NamedTuple):
    """Wanted ranks in an interval: weight below it, weight and rows in it."""

    below: int
    weight: int
    rows: int
    ranks: tuple[int, ...]


def _within(x: Column, interval: Interval) -> Column:
    inside = x.isNotNull()
    if interval.low is not None:
        inside = inside & (x > F.lit(interval.low))
    if interval.high is not None:
        inside = inside & (x < F.lit(interval.high))
    return inside


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _cuts(values) -> list[float]:
    """Distinct cut values in order (``-0.0`` and ``0.0`` are one value)."""
    return sorted({v + 0.0 for v in values or [] if v is not None})


class RawRows:
    """Numeric columns of a table, every row of weight one. Each round is one
    wide aggregate, so nothing is exploded or shuffled but its one row."""

    def __init__(self, df: DataFrame, values: dict[str, Column], accuracy: int):
        self.df, self.values, self.accuracy = df, values, accuracy
        self.reach = 8.0 / accuracy  # several times the sketch's rank error

    def _around(self, fractions: Sequence[float]) -> list[float]:
        points = {max(0.0, f - self.reach) for f in fractions} | {min(1.0, f + self.reach) for f in fractions}
        return sorted(points)

    def start(self, probs: Sequence[float]) -> dict[str, tuple[int, int, list[float]]]:
        at = self._around([float(p) for p in probs])
        aggs = []
        for j, x in enumerate(self.values.values()):
            aggs += [F.count(x).alias(f"n{j}"), F.percentile_approx(x, at, self.accuracy).alias(f"cuts{j}")]
        row = self.df.agg(*aggs).first()
        return {c: (int(row[f"n{j}"]), int(row[f"n{j}"]), _cuts(row[f"cuts{j}"])) for j, c in enumerate(self.values)}

    def _inside(self, searches) -> tuple[DataFrame, dict[Interval, Column]]:
        inside = {i: _within(self.values[i.column], i) for i in searches}
        return self.df.filter(_any(list(inside.values()))), inside

    def draw(self, searches: dict[Interval, Search]) -> dict[Interval, list[float]]:
        rows, inside = self._inside(searches)
        aggs = []
        for t, (i, s) in enumerate(searches.items()):
            at = self._around([(k - s.below) / s.weight for k in s.ranks])
            aggs.append(F.percentile_approx(F.when(inside[i], self.values[i.column]), at, self.accuracy).alias(f"cuts{t}"))
        row = rows.agg(*aggs).first()
        return {i: _cuts(row[f"cuts{t}"]) for t, i in enumerate(searches)}

    def count(self, searches: dict[Interval, Search], cuts: dict[Interval, list[float]]) -> dict[Interval, list[tuple[int, int]]]:
        rows, inside = self._inside(searches)
        aggs = []
        for t, i in enumerate(searches):
            x = self.values[i.column]
            for m, cut in enumerate(cuts[i]):
                aggs.append(F.count_if(inside[i] & (x < F.lit(cut))).alias(f"under{t}_{m}"))
                aggs.append(F.count_if(x == F.lit(cut)).alias(f"on{t}_{m}"))
        row = rows.agg(*aggs).first()
        out = {}
        for t, (i, s) in enumerate(searches.items()):
            pieces, done = [], 0
            for m in range(len(cuts[i])):
                under, on = int(row[f"under{t}_{m}"]), int(row[f"on{t}_{m}"])
                pieces += [(under - done,) * 2, (on,) * 2]
                done = under + on
            out[i] = [*pieces, (s.weight - done,) * 2]
        return out

    def read(self, searches: dict[Interval, Search]) -> dict[Interval, list[float]]:
        """The values at the wanted ranks, from one bounded buffer an interval."""
        rows, inside = self._inside(searches)
        held = rows.agg(
            *[F.sort_array(F.collect_list(F.when(inside[i], self.values[i.column]))).alias(f"held{t}") for t, i in enumerate(searches)]
        )
        row = held.select(
            *[F.array(*[F.get(f"held{t}", F.lit(k - s.below)) for k in s.ranks]).alias(f"v{t}") for t, s in enumerate(searches.values())]
        ).first()
        return {i: row[f"v{t}"] for t, i in enumerate(searches)}


class CountedValues:
    """Distinct values with their counts, ``(column, num, cnt)`` rows of many
    columns. Intervals are joined as a small table (one row for each wanted
    rank at most), so a round's plan does not grow with them."""

    def __init__(self, counts: DataFrame, accuracy: int):
        self.counts, self.accuracy = counts.filter(F.col("num").isNotNull()), accuracy
        self.at = [i / PARTS for i in range(PARTS + 1)]

    def start(self, probs: Sequence[float]) -> dict[str, tuple[int, int, list[float]]]:
        sketch = F.percentile_approx("num", self.at, self.accuracy)
        found = self.counts.groupBy("column").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("rows"), sketch.alias("cuts"))
        return {r["column"]: (int(r["n"]), int(r["rows"]), _cuts(r["cuts"])) for r in found.collect()}

    def _inside(self, intervals: list[Interval], cuts: dict[Interval, list[float]] | None = None) -> DataFrame:
        schema = "t int, __column string, low double, high double, cuts array<double>"
        rows = [(t, i.column, i.low, i.high, (cuts or {}).get(i, [])) for t, i in enumerate(intervals)]
        table = self.counts.sparkSession.createDataFrame(rows, schema)
        inside = (
            (F.col("column") == F.col("__column"))
            & (F.col("low").isNull() | (F.col("num") > F.col("low")))
            & (F.col("high").isNull() | (F.col("num") < F.col("high")))
        )
        return self.counts.join(F.broadcast(table), inside)

    def draw(self, searches: dict[Interval, Search]) -> dict[Interval, list[float]]:
        order = list(searches)
        found = self._inside(order).groupBy("t").agg(F.percentile_approx("num", self.at, self.accuracy).alias("cuts"))
        return {order[r["t"]]: _cuts(r["cuts"]) for r in found.collect()}

    def count(self, searches: dict[Interval, Search], cuts: dict[Interval, list[float]]) -> dict[Interval, list[tuple[int, int]]]:
        order = list(searches)
        # cuts under the value and cuts up to it: odd sums are values on a cut
        piece = F.size(F.filter("cuts", lambda v: v < F.col("num"))) + F.size(F.filter("cuts", lambda v: v <= F.col("num")))
        found = (
            self._inside(order, cuts)
            .groupBy("t", piece.alias("piece"))
            .agg(F.sum("cnt").alias("weight"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        out = {i: [(0, 0)] * (2 * len(cuts[i]) + 1) for i in order}
        for r in found:
            out[order[r["t"]]][r["piece"]] = (int(r["weight"]), int(r["rows"]))
        return out

    def read(self, searches: dict[Interval, Search]) -> dict[Interval, list[float]]:
        order = list(searches)
        held = F.sort_array(F.collect_list(F.struct("num", "cnt")))
        out = {}
        for r in self._inside(order).groupBy("t").agg(held.alias("held")).collect():
            s = searches[order[r["t"]]]
            values, end, at = [], s.below, iter(r["held"])
            num = None
            for k in s.ranks:
                while end <= k:
                    num, cnt = next(at)
                    end += cnt
                values.append(num)
            out[order[r["t"]]] = values
        return out


def _positions(n: int, p: float) -> tuple[float, int, int]:
    """Position of a quantile among ``n`` sorted rows and the ranks beside it."""
    pos = (n - 1) * float(p)
    return pos, int(pos // 1), min(n - 1, int(-(-pos // 1)))


def select(source: RawRows | CountedValues, probs: Sequence[float], hold: int = HOLD) -> list[tuple[str, int, float, float]]:
    """``(column, p_index, prob, value)`` rows of every column of ``source``
    that has a value. Driver-side rows: columns x probabilities."""
    start = {c: s for c, s in source.start(probs).items() if s[0]}
    searches: dict[Interval, Search] = {}
    cuts: dict[Interval, list[float]] = {}
    for c, (n, rows, drawn) in start.items():
        ranks = sorted({k for p in probs for k in _positions(n, p)[1:]})
        searches[Interval(c, None, None)] = Search(0, n, rows, tuple(ranks))
        cuts[Interval(c, None, None)] = drawn
    share = max(1, hold // max(1, sum(len(s.ranks) for s in searches.values())))

    found: dict[tuple[str, int], float] = {}
    few: dict[Interval, Search] = {}
    while searches:
        few.update({i: s for i, s in searches.items() if s.rows <= share})
        searches = {i: s for i, s in searches.items() if s.rows > share}
        if not searches:
            break
        if not cuts:
            cuts = source.draw(searches)
        counted = source.count(searches, cuts)
        pieces: dict[Interval, Search] = {}
        for i, s in searches.items():
            edges, below = [i.low, *cuts[i], i.high], s.below
            for m, (weight, rows) in enumerate(counted[i]):
                ranks = tuple(k for k in s.ranks if below <= k < below + weight)
                if ranks and m % 2:
                    found.update({(i.column, k): cuts[i][m // 2] for k in ranks})
                elif ranks:
                    pieces[Interval(i.column, edges[m // 2], edges[m // 2 + 1])] = Search(below, weight, rows, ranks)
                below += weight
        searches, cuts = pieces, {}
    if few:
        for i, values in source.read(few).items():
            found.update({(i.column, k): v + 0.0 for k, v in zip(few[i].ranks, values)})

    out = []
    for c, (n, _, _) in start.items():
        for at, p in enumerate(probs):
            pos, lo, hi = _positions(n, p)
            a, b = found[c, lo], found[c, hi]
            out.append((c, at, float(p), a if a == b or pos == lo else a + (b - a) * (pos - lo)))
    return out


def as_table(spark, rows: list[tuple[str, int, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)
