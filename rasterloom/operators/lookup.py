"""Strict lookups and priority joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to be sent to every task: a palette has 1,024 at most.
SMALL_ROWS = 100_000


def maybe_broadcast(df: DataFrame, most_rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows, which is counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def strict_lookup(rows: DataFrame, key: str, table: DataFrame, entry: str) -> DataFrame:
    """Rows with the columns of their table entry. An entry that the table lacks is an error, never a default.

    Keys are checked row by row within the join, so there is no second pass over the rows.
    """
    held = table.withColumn("_found", F.lit(True))
    joined = rows.join(maybe_broadcast(held), rows[key] == held[entry], "left")
    known = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no entry "), F.col(key).cast("string")))).otherwise(F.col("_found"))
    return joined.withColumn("_found", known).where("_found").drop("_found", entry)


def effective(*priorities: Column) -> Column:
    """The first parameter that is set: tile over main header, component over default."""
    return F.coalesce(*priorities)


def channel_of(parts: list[Column], definitions: list[tuple[int, int, bool]], colour: int) -> Column:
    """The component of a colour by definitions (channel, association, opacity), or else the one of the whole image."""
    own = [parts[c] for c, a, alpha in definitions if a == colour]
    grey = [parts[c] for c, a, alpha in definitions if a == 0 and not alpha]
    return F.coalesce(*own, *grey, F.lit(None))


def opacity_of(parts: list[Column], definitions: list[tuple[int, int, bool]]) -> Column:
    return F.coalesce(*[parts[c] for c, _, alpha in definitions if alpha], F.lit(None))


def positional_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by position; a position that one side lacks has null there and `matched` false."""
    left = a.withColumn("_a", F.lit(True))
    right = b.withColumn("_b", F.lit(True))
    both = left.join(right, keys, "full_outer")
    return both.withColumn("matched", F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")
