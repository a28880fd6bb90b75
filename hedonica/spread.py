"""A lookup join above the broadcast bound that no frequent key can hold up.

A shuffled join sends all rows of a key to one task. Here a first aggregate, combined map-side,
counts the rows of each key. A key with more than ``hot_rows`` rows is hot: its rows are dealt to
``ceil(rows / hot_rows)`` salts, and its row of the lookup table, only that one, is copied to each
of them. All other rows have salt 0 and are joined as ever. How the work is dealt doesn't depend
on adaptive execution or on its settings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedonica.session import settled

HOT_ROWS = 1_000_000


def fresh(df: DataFrame, *others: DataFrame, names: list[str]) -> list[str]:
    """The names with as many underscores as no table has a column of that name."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while any(n.lower() in taken for n in names):
        names = [f"_{n}" for n in names]
    return names


def same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def hot_keys(df: DataFrame, keys: list[str], names: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of more than ``hot_rows`` rows, as ``names``, and their number of salts."""
    *key_names, salts = names
    return (
        df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, key_names)])
        .agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias(salts))
        .where(F.col(salts) > 1)
    )


def spread_lookup(
    df: DataFrame, table: DataFrame, keys: dict[str, str], how: str = "left",
    hot_rows: int | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row for each key at most.

    ``keys`` maps columns of ``df`` to columns of ``table``; other names must not clash. NULL
    matches NULL, and may be hot. Rows of each key are counted in ``counted``, or else in ``df``,
    which is read twice then. The place of a row in its task, which decides its salt, must not
    change when it is read again, as holds for files.
    """
    *names, salts, salt = fresh(df, table, names=[f"key{i}" for i in range(len(keys))] + ["salts", "salt"])
    hot, small = settled(hot_keys(counted or df, list(keys), [*names, salts], hot_rows or HOT_ROWS), "hot-keys")

    def with_salts(rows: DataFrame, columns: list[str]) -> DataFrame:
        on = same([rows[c] for c in columns], [hot[n] for n in names])
        joined = rows.join(F.broadcast(hot) if small else hot, on, "left")
        return joined.select(*rows.columns, F.coalesce(salts, F.lit(1)).alias(salts))

    dealt = with_salts(df, list(keys)).withColumn(
        salt, F.pmod(F.monotonically_increasing_id(), F.col(salts)).cast("int")
    )
    copied = with_salts(table, list(keys.values())).withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1))
    )
    copied = copied.withColumnsRenamed({v: n for v, n in zip(keys.values(), names)} | {salt: f"{salt}_of"})
    on = same([dealt[k] for k in keys] + [dealt[salt]], [copied[n] for n in names] + [copied[f"{salt}_of"]])
    values = [c for c in table.columns if c not in keys.values()]
    return dealt.drop(salts).join(copied.drop(salts), on, how).select(*df.columns, *values)
