"""Running totals over ordered keys, spread over many tasks even for one hot key.

A window partitioned by a key puts every row of that key into one task. Here rows are
range-partitioned by key *and* order, so a hot key spans several partitions ("runs").
Each run is scanned on its own; the totals of earlier runs, at most one row per run and
key, are then added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import cut

RUN = "_run"


def split_runs(df: DataFrame, keys: list[str], order: list[str | Column], runs: int | None = None) -> DataFrame:
    """Range-partition by `keys + order` and number the partitions in `_run`.

    The rows are written to the shared folder: both passes of a scan must see the same cut
    points, also after an executor is lost. Pass narrow rows. `order` must be unique per key.
    """
    count = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn(RUN, F.spark_partition_id()))


def scan(
    runs: DataFrame,
    keys: list[str],
    order: list[str | Column],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running `sum` or `max` columns: `{name: ("sum" | "max", value)}`.

    With `inclusive=False` a row sees only the rows before it. Null is a key like any other:
    inside a struct it joins to itself.
    """
    inputs = runs.select(
        "*",
        F.struct(F.lit(0).alias("_"), *keys).alias("_key"),
        *[v.alias(f"_in_{n}") for n, (_, v) in values.items()],
    )
    group = ["_key", RUN]
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy("_key").orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    functions = {"sum": F.sum, "max": F.max}

    carried = inputs.groupBy(*group).agg(
        *[functions[f](f"_in_{n}").alias(f"_run_{n}") for n, (f, _) in values.items()]
    )
    carried = carried.select(
        *group, *[functions[f](f"_run_{n}").over(across).alias(f"_before_{n}") for n, (f, _) in values.items()]
    )
    local = inputs.select(
        *runs.columns,
        "_key",
        *[functions[f](f"_in_{n}").over(inside).alias(f"_local_{n}") for n, (f, _) in values.items()],
    )

    def total(name: str, function: str) -> Column:
        before, here = F.col(f"_before_{name}"), F.col(f"_local_{name}")
        if function == "sum":
            return F.coalesce(before + here, before, here)
        # a comparison on structs or numbers; nulls never win
        return F.when(here.isNull() | (before > here), before).otherwise(here)

    return local.join(carried, group).select(
        *runs.columns, *[total(n, f).alias(n) for n, (f, _) in values.items()]
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rn") -> DataFrame:
    """`row_number()` per key without one task per key."""
    numbered = scan(split_runs(df, keys, order), keys, order, {name: ("sum", F.lit(1).cast("bigint"))})
    return numbered.drop(RUN)
