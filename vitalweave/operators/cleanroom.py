"""Aggregates under differential privacy, the privacy budget and query lineage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalweave.functions.groups import running_total, top_n_per_key
from vitalweave.functions.ranges import sorted_ranges
from vitalweave.session import cut_lineage

#: Budgets are counted in millionths, so that sums are exact.
UNITS = 1_000_000


@dataclass(frozen=True)
class Bounds:
    """Limits that fix the sensitivity: values are clamped and each person gives at most ``rows`` rows."""

    low: float
    high: float
    rows: int = 1


def _noise(scale: float, seed: int | None, keys: Sequence[str], draw: str) -> Column:
    """Independent Laplace draw for each result row. A seed repeats the draws and is for tests only."""
    if seed is None:
        unit = F.rand()
    else:
        mixed = F.xxhash64(F.lit(seed), F.lit(draw), *[F.col(k).cast("string") for k in keys])
        unit = F.pmod(mixed, F.lit(2**52)).cast("double") / float(2**52)
    u = F.greatest(F.least(unit, F.lit(1 - 1e-12)), F.lit(1e-12)) - 0.5
    return -F.lit(float(scale)) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def bounded_rows(df: DataFrame, person: str, value: str, bounds: Bounds, row_id: str, order: Sequence[Column] = ()) -> DataFrame:
    """At most ``bounds.rows`` rows with a value of each person, with clamped values.

    Which ones is settled by a hash of the row's id, or by a total ``order``.
    """
    chosen = list(order) or [F.xxhash64(row_id), F.asc(row_id)]
    kept = top_n_per_key(df.filter(F.col(value).isNotNull()), [person], chosen, bounds.rows)
    clamped = F.greatest(F.least(F.col(value).cast("double"), F.lit(bounds.high)), F.lit(bounds.low))
    return kept.withColumn(value, clamped)


def exact_aggregate(
    df: DataFrame, keys: Sequence[str], person: str, value: str, bounds: Bounds, row_id: str, public_keys: DataFrame, order: Sequence[Column] = ()
) -> DataFrame:
    """Count, sum and mean of the bounded rows for every public key, also for keys without rows."""
    rows = bounded_rows(df.join(public_keys, list(keys), "left_semi"), person, value, bounds, row_id, order)
    grouped = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    whole = public_keys.select(*keys).distinct().join(grouped, list(keys), "left").na.fill(0, ["n"]).na.fill(0.0, ["total"])
    return whole.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def dp_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    person: str,
    value: str,
    bounds: Bounds,
    row_id: str,
    public_keys: DataFrame,
    epsilon: float,
    seed: int | None = None,
) -> DataFrame:
    """Noisy count, sum and mean per public key; half of ``epsilon`` goes to the count, half to the sum.

    The group list is public, so that a rare key shows nothing by being present.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    exact = exact_aggregate(df, keys, person, value, bounds, row_id, public_keys)
    share = epsilon / 2
    reach = max(abs(bounds.low), abs(bounds.high))
    noisy = exact.withColumns(
        {
            "noisy_n": F.col("n") + _noise(bounds.rows / share, seed, keys, "count"),
            "noisy_total": F.col("total") + _noise(bounds.rows * reach / share, seed, keys, "sum"),
        }
    )
    mean = F.col("noisy_total") / F.greatest(F.col("noisy_n"), F.lit(1.0))
    inside = F.greatest(F.least(mean, F.lit(bounds.high)), F.lit(bounds.low))
    return noisy.select(*keys, "noisy_n", "noisy_total", inside.alias("noisy_mean"), F.lit(epsilon).alias("epsilon_used"))


def budget_ledger(log: DataFrame, limit: float, bucket: Column | None = None) -> DataFrame:
    """Adds ``used`` (running sum of epsilon per owner) and ``accepted``.

    A query is refused once the total asked for by its owner passes the limit.
    """
    step = bucket if bucket is not None else F.date_trunc("hour", F.col("asked_at"))
    # Sums run on integers, so that the result does not depend on the order of addition.
    units = F.round(F.col("epsilon") * 1_000_000).cast("bigint")
    rows = running_total(log, ["owner"], [F.asc("asked_at"), F.asc("query_id")], units, step, "_used")
    return rows.withColumn("used", F.col("_used") / 1_000_000).withColumn(
        "accepted", F.col("_used") <= F.lit(round(limit * 1_000_000))
    ).drop("_used")


def admit_queries(log: DataFrame, limit: float) -> DataFrame:
    """Adds ``accepted`` and ``used`` to the queries (query_id, owner, epsilon, asked_at): only accepted ones are charged.

    A query is accepted if what its owner has been charged so far, with it, stays within the limit.
    What is charged depends on every decision before, so the log is sorted into ranges and each
    range folds its owners in order. An owner in several ranges goes on in the next one with what is
    left; where that is less than the smallest query there, the range is refused without a fold.
    """
    columns = log.columns
    rows = log.withColumn("_units", F.round(F.col("epsilon") * UNITS).cast("bigint"))
    ranged = sorted_ranges(rows, [F.asc("owner"), F.asc("asked_at"), F.asc("query_id")], "_part")
    within = Window.partitionBy("owner").orderBy("_part")
    parts = ranged.groupBy("owner", "_part").agg(F.min("_units").alias("_least"))
    parts = cut_lineage(parts.withColumn("_turn", F.row_number().over(within)))
    budget = round(limit * UNITS)
    # Every range ends and begins within one owner at most, so these are no more than there are ranges.
    later = sorted((r["_turn"], r["_part"], r["owner"], r["_least"]) for r in parts.filter("_turn > 1").collect())
    first = parts.filter("_turn = 1").select("owner", "_part", F.lit(budget).cast("bigint").alias("_left"))
    done = [cut_lineage(_folded(ranged, first, budget))]
    names = {owner for _, _, owner, _ in later}
    left = _remaining(done[0], names, budget)
    waiting: list[tuple[str, int, int]] = []
    for turn in sorted({t for t, *_ in later}):
        asked = [(owner, part) for t, part, owner, least in later if t == turn and left[owner] >= least]
        waiting += [(owner, part, left[owner]) for t, part, owner, least in later if t == turn and left[owner] < least]
        if asked:
            table = log.sparkSession.createDataFrame([(o, p, left[o]) for o, p in asked], PARTS)
            done.append(cut_lineage(_folded(ranged, table, budget)))
            left.update(_remaining(done[-1], {o for o, _ in asked}, budget))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    if waiting:
        refused = ranged.join(log.sparkSession.createDataFrame(waiting, PARTS), ["owner", "_part"])
        refused = refused.withColumns({"accepted": F.lit(False), "_used": F.lit(budget) - F.col("_left")})
        whole = whole.unionByName(refused.select(whole.columns))
    return whole.select(*columns, "accepted", (F.col("_used") / UNITS).alias("used"))


PARTS = "owner string, _part int, _left bigint"


def _folded(ranged: DataFrame, parts: DataFrame, budget: int) -> DataFrame:
    """Rows of the given (owner, part) with their decisions, from what is left of the budget (_left) on."""
    rows = ranged.join(parts, ["owner", "_part"])
    schema = T.StructType([*ranged.schema.fields, T.StructField("_left", T.LongType()), T.StructField("accepted", T.BooleanType()), T.StructField("_used", T.LongType())])
    names = [f.name for f in schema.fields]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("asked_at", "ascending"), ("query_id", "ascending")])
        left = table.column("_left")[0].as_py()
        accepted, used = [], []
        for units in table.column("_units").to_pylist():
            fits = units is not None and units <= left
            left -= units if fits else 0
            accepted.append(fits)
            used.append(budget - left)
        table = table.append_column("accepted", pa.array(accepted, pa.bool_())).append_column("_used", pa.array(used, pa.int64()))
        return table.select(names)

    return rows.select(names[:-2]).groupBy("owner", "_part").applyInArrow(fold, schema)


def _remaining(folded: DataFrame, owners: set[str], budget: int) -> dict[str, int]:
    """What is left to each of the owners after these rows."""
    if not owners:
        return {}
    spent = folded.filter(F.col("owner").isin(sorted(owners))).groupBy("owner").agg(F.max("_used").alias("used"))
    return {r["owner"]: budget - r["used"] for r in spent.collect()}


class BudgetSpent(ValueError):
    """The owner's privacy budget does not admit the query."""


def answer_query(
    df: DataFrame,
    keys: Sequence[str],
    person: str,
    value: str,
    bounds: Bounds,
    row_id: str,
    public_keys: DataFrame,
    epsilon: float,
    log: DataFrame,
    limit: float,
    query: tuple[object, str, object],
    seed: int | None = None,
) -> DataFrame:
    """:func:`dp_aggregate` if the owner's budget admits the query (query_id, owner, asked_at); raises :class:`BudgetSpent` if not."""
    query_id, owner, asked_at = query
    kinds = {c: log.schema[c].dataType for c in ("query_id", "owner", "epsilon", "asked_at")}
    entry = log.sparkSession.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(kinds, (query_id, owner, epsilon, asked_at))])
    ledger = admit_queries(log.filter(F.col("owner") == owner).select(*kinds).unionByName(entry), limit)
    if not ledger.filter(F.col("query_id") == F.lit(query_id)).first()["accepted"]:
        raise BudgetSpent(f"{owner} has less than {epsilon} of {limit} left")
    return dp_aggregate(df, keys, person, value, bounds, row_id, public_keys, epsilon, seed)


def lineage(log: DataFrame, query_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, position, source) of each query, of the listed ones when given."""
    wanted = log if query_ids is None else log.join(query_ids.select("query_id").distinct(), "query_id", "left_semi")
    return wanted.select("query_id", F.posexplode("sources").alias("position", "source"))
