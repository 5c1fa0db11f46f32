"""Running values within a key of any size: last value, sums, totals and streaks, as a scan in two passes.

Rows are range-partitioned by key and order and written; a range is cut into runs of a bounded number of rows. The first pass
computes each value inside a run with window functions and sums a run up in one row; these rows, one for each key and run, are
folded in order, and what came before a run is joined back and added to its values. All values are associative, so that it
makes no difference where runs are cut. No task holds more of a key than a run. Where no key is longer than a run, the
windows alone do, without the writing and joining; the results are equal.

Nulls: keys that are null are one key. Null values don't change a last value or a sum. Rows that are equal in all of ``order``
come in any order among them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cadenza.sources.shared import written

#: Rows of a key that one task takes.
RUN = 1 << 20
#: Hashes of keys that are counted, a bound of the rows that this shuffles and sends to the driver.
HASHES = 1 << 14
START, BEFORE, NOW = Window.unboundedPreceding, -1, 0

#: A window over more columns than the key and run, in order and up to the current row or the one before.
Over = Callable[..., WindowSpec]


@dataclass(frozen=True)
class Last:
    """The last value that isn't null, up to the current row, or before it."""

    value: Column
    inclusive: bool = True

    def local(self, p: str, over: Over) -> list[dict[str, Column]]:
        return [{f"{p}v": self.value}, {f"{p}x": F.last(f"{p}v", ignorenulls=True).over(over(upto=NOW if self.inclusive else BEFORE))}]

    def total(self, p: str) -> dict[str, Column]:
        return {f"{p}t": F.max_by(f"{p}v", F.when(F.col(f"{p}v").isNotNull(), F.col("_at")))}

    def fold(self, p: str, over: Over) -> list[dict[str, Column]]:
        return [{f"{p}c": F.last(f"{p}t", ignorenulls=True).over(over(upto=BEFORE))}]

    def result(self, p: str, names: list[str], carried: bool) -> dict[str, Column]:
        return {names[0]: F.coalesce(f"{p}x", f"{p}c") if carried else F.col(f"{p}x")}


@dataclass(frozen=True)
class Sum:
    """The sum of a long or double up to the current row, or before it; with ``since``, from the last row on where that holds."""

    value: Column
    inclusive: bool = True
    since: Column | None = None

    def local(self, p: str, over: Over) -> list[dict[str, Column]]:
        since = F.lit(False) if self.since is None else F.coalesce(self.since, F.lit(False))
        value = F.coalesce(self.value, F.lit(0))
        return [{f"{p}v": value, f"{p}s": since}, {f"{p}e": F.count_if(f"{p}s").over(over())}, {f"{p}i": F.sum(f"{p}v").over(over(f"{p}e"))}]

    def total(self, p: str) -> dict[str, Column]:
        return {f"{p}t": F.max_by(f"{p}i", "_at"), f"{p}b": F.bool_or(f"{p}s")}

    def fold(self, p: str, over: Over) -> list[dict[str, Column]]:
        return [
            {f"{p}k": F.count_if(f"{p}b").over(over())},
            {f"{p}z": F.sum(f"{p}t").over(over(f"{p}k"))},
            {f"{p}c": F.lag(f"{p}z").over(over(upto=None))},
        ]

    def result(self, p: str, names: list[str], carried: bool) -> dict[str, Column]:
        whole = F.col(f"{p}i") + F.when(F.col(f"{p}e") == 0, F.coalesce(f"{p}c", F.lit(0))).otherwise(0) if carried else F.col(f"{p}i")
        return {names[0]: whole if self.inclusive else whole - F.col(f"{p}v")}


@dataclass(frozen=True)
class Total:
    """The sum over the whole key, on each row."""

    value: Column

    def local(self, p: str, over: Over) -> list[dict[str, Column]]:
        return [{f"{p}v": self.value}, {f"{p}x": F.sum(f"{p}v").over(over(upto=Window.unboundedFollowing))}]

    def total(self, p: str) -> dict[str, Column]:
        return {f"{p}t": F.sum(f"{p}v")}

    def fold(self, p: str, over: Over) -> list[dict[str, Column]]:
        return [{f"{p}c": F.sum(f"{p}t").over(over(upto=Window.unboundedFollowing))}]

    def result(self, p: str, names: list[str], carried: bool) -> dict[str, Column]:
        return {names[0]: F.col(f"{p}c" if carried else f"{p}x")}


@dataclass(frozen=True)
class Streak:
    """Two columns: the number of hits since the last miss, and the most that it has been; both from the last ``since`` on."""

    hit: Column
    miss: Column
    since: Column

    def local(self, p: str, over: Over) -> list[dict[str, Column]]:
        hit, miss, since = (F.coalesce(x, F.lit(False)) for x in (self.hit, self.miss, self.since))
        return [
            {f"{p}h": hit.cast("long"), f"{p}m": miss | since, f"{p}s": since},
            {f"{p}e": F.count_if(f"{p}s").over(over()), f"{p}l": F.count_if(f"{p}m").over(over())},
            {f"{p}x": F.sum(f"{p}h").over(over(f"{p}l"))},
            # while nothing was missed in the run, a streak may have begun before it
            {f"{p}y": F.max(f"{p}x").over(over(f"{p}e")), f"{p}p": F.coalesce(F.max(F.when(F.col(f"{p}l") == 0, F.col(f"{p}x"))).over(over()), F.lit(0))},
        ]

    def total(self, p: str) -> dict[str, Column]:
        return {f"{p}t": F.max_by(f"{p}x", "_at"), f"{p}b": F.bool_or(f"{p}m"), f"{p}r": F.bool_or(f"{p}s"), f"{p}u": F.max_by(f"{p}y", "_at"), f"{p}q": F.max_by(f"{p}p", "_at")}

    def fold(self, p: str, over: Over) -> list[dict[str, Column]]:
        return [
            {f"{p}k": F.count_if(f"{p}b").over(over()), f"{p}j": F.count_if(f"{p}r").over(over())},
            {f"{p}z": F.sum(f"{p}t").over(over(f"{p}k"))},
            {f"{p}c": F.coalesce(F.lag(f"{p}z").over(over(upto=None)), F.lit(0))},
            {f"{p}w": F.max(F.when(F.col(f"{p}r"), F.col(f"{p}u")).otherwise(F.greatest(f"{p}u", F.col(f"{p}c") + F.col(f"{p}q")))).over(over(f"{p}j"))},
            {f"{p}d": F.coalesce(F.lag(f"{p}w").over(over(upto=None)), F.lit(0))},
        ]

    def result(self, p: str, names: list[str], carried: bool) -> dict[str, Column]:
        now, best = F.col(f"{p}x"), F.col(f"{p}y")
        if carried:
            began = F.coalesce(f"{p}c", F.lit(0))
            best = F.when(F.col(f"{p}e") == 0, F.greatest(best, F.coalesce(f"{p}d", F.lit(0)), began + F.col(f"{p}p"))).otherwise(best)
            now = now + F.when(F.col(f"{p}l") == 0, began).otherwise(0)
        return {names[0]: now, names[1]: best}


Scan = Last | Sum | Total | Streak


def longest(rows: DataFrame, key: list[str]) -> int:
    """How many rows the largest key has."""
    return rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0


def longer(rows: DataFrame, key: list[str], run: int) -> bool:
    """Whether a key has more than ``run`` rows. Hashes of keys are counted first, so that few rows are shuffled; keys are counted
    only where a hash has that many."""
    code = F.pmod(F.xxhash64(*key), F.lit(HASHES))
    full = [r["_code"] for r in rows.groupBy(code.alias("_code")).count().where(F.col("count") > run).select("_code").collect()]
    return bool(full) and longest(rows.where(code.isin(full)), key) > run


def over(by: list[str], order: list[Column]) -> Over:
    def window(*more: str, upto: int | None = NOW) -> WindowSpec:
        w = Window.partitionBy(*by, *more).orderBy(*order)
        return w if upto is None else w.rowsBetween(START, upto)

    return window


def runs(rows: DataFrame, key: list[str], order: list[Column], run: int) -> DataFrame:
    """``rows`` as a written table, sorted by key and order in ranges, with _at, the place, and _run, the run of at most ``run``
    rows; both rise in that order."""
    by = [*(F.col(k) for k in key), *order]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "runs")
    nth = F.col("_at").bitwiseAND((1 << 33) - 1)  # the place in the range; what precedes it in the id is the range
    return placed.withColumn("_run", F.shiftright("_at", 33) * (1 << 33) + F.floor(nth / run))


def scanned(rows: DataFrame, key: list[str], order: list[Column], scans: dict[str | tuple[str, ...], Scan], *, run: int = RUN) -> DataFrame:
    """``rows`` with a column for each scan (two for a Streak: its name is a pair), in each key by ``order``."""
    split = longer(rows, key, run)
    laid = runs(rows, key, order, run) if split else rows
    by = [*key, "_run"] if split else key
    window = over(by, [F.col("_at")] if split else order)
    named = [(f"_scan{n}_", [name] if isinstance(name, str) else [*name], scan) for n, (name, scan) in enumerate(scans.items())]
    for p, _, scan in named:
        for stage in scan.local(p, window):
            laid = laid.withColumns(stage)
    if split:
        totals = laid.groupBy(*by).agg(*(c.alias(n) for p, _, scan in named for n, c in scan.total(p).items()))
        fold = over(key, [F.col("_run")])
        for p, _, scan in named:
            for stage in scan.fold(p, fold):
                totals = totals.withColumns(stage)
        carries = [c for c in totals.columns if c[-1] in "cd" and c.startswith("_scan")]
        before = totals.select(*(F.col(c).alias(f"_of_{c}") for c in by), *carries)
        laid = laid.join(before, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by)))
    found: dict[str, Column] = {}
    for p, names, scan in named:
        found |= scan.result(p, names, split)
    return laid.select(*rows.columns, *(c.alias(n) for n, c in found.items()))
