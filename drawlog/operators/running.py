"""Running values over groups of any size.

A plain window sends a whole group to one task.  Here a group is cut into
blocks along its order: a window runs inside each block, block totals (one
small row per block) are accumulated across blocks, and the carry is joined
back on (keys, block).  A group holding a third of the table is spread over as
many tasks as it has blocks, and no row is dropped or sampled.

``block`` must not decrease along ``order`` inside a group.  Draw logs use
:func:`seq_block`, other tables a coarse form of their leading order column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


@dataclass(frozen=True)
class Run:
    """One running value: ``op`` is sum, min, max, last (last non-null) or depth.

    depth follows a walk whose steps are the values and that never goes below
    zero: S - min(0, lowest S so far), S being the running sum.
    """

    op: str
    value: Column
    inclusive: bool = True


def seq_block(col: str = "sequence", size: int | None = None) -> Column:
    return F.floor((F.col(col) - 1) / F.lit(size or BLOCK_ROWS))


def log_block(log: DataFrame, block_rows: int | None = None) -> Column | None:
    """:func:`seq_block` of a log, or None where all its rows lie in one block: then a pass needs no carry.

    Looked up once for each log object.
    """
    known = log.__dict__.setdefault("_drawlog_blocks", {})
    if block_rows not in known:
        block = seq_block(size=block_rows)
        first, last = log.agg(F.min(block), F.max(block)).first()
        known[block_rows] = first == last
    return None if known[block_rows] else seq_block(size=block_rows)


def block_of(df: DataFrame, keys: list[str], block: Column, rows: int = BLOCK_ROWS) -> Column | None:
    """``block``, or None where no group of ``df`` has over ``rows`` rows."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return None if (largest or 0) <= rows else block


def _fold(op: str, c: Column) -> Column:
    if op == "sum":
        return F.sum(c)
    if op == "min":
        return F.min(c)
    if op == "max":
        return F.max(c)
    if op == "last":
        return F.last(c, ignorenulls=True)
    raise ValueError(op)


def _join_carry(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if op == "min":
        return F.least(carry, local)
    if op == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def _alone(n: str, op: str) -> Column:
    """The running value of a group that is one block."""
    if op == "depth":
        return (F.col(f"_s_{n}") - F.least(F.col(f"_m_{n}"), F.lit(0))).cast("bigint").alias(n)
    return (F.coalesce(f"_l_{n}", F.lit(0)) if op == "sum" else F.col(f"_l_{n}")).alias(n)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    runs: dict[str, Run],
) -> DataFrame:
    """Add one running column per entry of ``runs``.

    ``order`` names columns that give a total order inside a group.  Without
    ``block`` a group is one block, and the input is read once.
    """
    names = list(runs)
    depths = [n for n in names if runs[n].op == "depth"]
    plain = [n for n in names if runs[n].op != "depth"]
    cols = df.columns
    cut = [] if block is None else ["_b"]
    groups = Window.partitionBy(*keys, *cut).orderBy(*order)
    incl = groups.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = groups.rowsBetween(Window.unboundedPreceding, -1)
    src = df.select(*cols, *[block.alias(c) for c in cut], *[runs[n].value.alias(f"_v_{n}") for n in names])
    for n in depths:
        src = src.withColumn(f"_s_{n}", F.sum(f"_v_{n}").over(incl))
    local = src.select(
        *cols,
        *cut,
        *[
            _fold(runs[n].op, F.col(f"_v_{n}")).over(incl if runs[n].inclusive else excl).alias(f"_l_{n}")
            for n in plain
        ],
        *[c for n in depths for c in (F.col(f"_s_{n}"), F.min(f"_s_{n}").over(incl).alias(f"_m_{n}"))],
    )
    if block is None:
        return local.select(*cols, *[_alone(n, runs[n].op) for n in names])
    position = F.struct(*order)
    totals = src.groupBy(*keys, "_b").agg(
        *[
            (
                F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position))
                if runs[n].op == "last"
                else _fold(runs[n].op, F.col(f"_v_{n}"))
            ).alias(f"_t_{n}")
            for n in plain
        ],
        *[c for n in depths for c in (F.sum(f"_v_{n}").alias(f"_t_{n}"), F.min(f"_s_{n}").alias(f"_tm_{n}"))],
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_b",
        *[_fold(runs[n].op, F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n in plain],
        *[
            c
            for n in depths
            for c in (F.col(f"_tm_{n}"), F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}"))
        ],
    )
    for n in depths:
        carry = carry.withColumn(f"_cm_{n}", F.min(F.col(f"_c_{n}") + F.col(f"_tm_{n}")).over(before)).drop(f"_tm_{n}")

    def finish(n: str) -> Column:
        if runs[n].op != "depth":
            return _join_carry(runs[n].op, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n)
        total = F.col(f"_s_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        lowest = F.least(
            F.col(f"_m_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)), F.col(f"_cm_{n}"), F.lit(0)
        )
        return (total - lowest).cast("bigint").alias(n)

    # One row per group and block: never broadcast.
    return local.join(carry.hint("merge"), [*keys, "_b"], "left").select(*cols, *[finish(n) for n in names])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], block: Column | None, name: str) -> DataFrame:
    return running(df, keys, order, block, {name: Run("sum", F.lit(1).cast("bigint"))})
