"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmart.sources.tables import fits, materialize

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 10_000
SALTS = 200
BLOCK_ROWS = 20_000


def _small(hot: DataFrame, keys: int | None = None) -> DataFrame:
    """A table of hot keys, which has few rows, to be broadcast unless its keys are very long texts."""
    hot = materialize(hot, "hot-keys")
    return F.broadcast(hot) if fits(hot, keys or HOT_KEYS, BROADCAST_BYTES) else hot


def hot_part(weighted: DataFrame, weight: str, keys: int | None = None) -> DataFrame:
    """The rows whose weight is above 1/keys of the total: fewer than `keys` (HOT_KEYS) by construction."""
    total = weighted.agg(F.sum(weight)).scalar()
    return weighted.where(F.col(weight) * (keys or HOT_KEYS) > total)


def join_weighted(rows: DataFrame, table: DataFrame, key: str, weight: str, keys: int | None = None) -> DataFrame:
    """Inner join to `table`, which has one row per key and the number of `rows` with it in `weight`.

    Hot keys are looked up in a broadcast of fewer than HOT_KEYS rows and never shuffled. Only the
    others are, and none of them has more than 1/HOT_KEYS of the rows. `rows` is read twice, so it
    should be cheap to read. `keys` stands in for HOT_KEYS; then a table of at most `keys` rows and BROADCAST_BYTES, which is
    at rest, is broadcast whole and `rows` is read once.
    """
    columns = rows.columns + [c for c in table.columns if c != key]
    if keys and fits(table, keys, BROADCAST_BYTES):
        return rows.join(F.broadcast(table), key).select(*columns)
    hot = _small(hot_part(table, weight, keys), keys)
    frequent = rows.join(hot, key).select(*columns)
    others = rows.join(hot.select(key), key, "left_anti").join(table, key).select(*columns)
    return frequent.unionByName(others)


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False,
           broadcast_rows: int = BROADCAST_ROWS, counted_on: DataFrame | None = None) -> DataFrame:
    """Add the columns of `table`, which is at rest and has few rows per key, to `rows`.

    A table of at most `broadcast_rows` rows and BROADCAST_BYTES is broadcast. A larger one is
    shuffled, and the keys with more than 1/HOT_KEYS of the rows are salted: their rows are dealt
    out over SALTS shares, and their few table rows are repeated for each share. With `null_safe`,
    null keys match null keys. `counted_on` is a cheaper DataFrame to count the keys on, if `rows`
    takes work to compute.
    """
    keys = list(on)
    extra = [c for c in table.columns if c not in keys]
    table = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *extra)
    matches = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) if null_safe else F.col(k) == F.col(f"_k_{k}")
               for k in keys]
    if fits(table, broadcast_rows, BROADCAST_BYTES):
        return rows.join(F.broadcast(table), matches, how).select(*rows.columns, *extra)

    counts = materialize((rows if counted_on is None else counted_on).groupBy(*keys).count(), "key-counts")
    hot = hot_part(counts, "count").select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    hot = _small(hot)

    def with_share(df: DataFrame, prefix: str, name: str, share_of_hot) -> DataFrame:
        same = [F.col(f"{prefix}{k}").eqNullSafe(F.col(f"_h_{k}")) for k in keys]
        share = F.when(F.col("_hot"), share_of_hot(df)).otherwise(F.array(F.lit(0)))
        return df.join(hot, same, "left").select(*df.columns, F.explode(share).alias(name))

    dealt = with_share(rows, "", "_share", lambda df: F.array(F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")))
    repeated = with_share(table, "_k_", "_k_share", lambda df: F.sequence(F.lit(0), F.lit(SALTS - 1)))
    matches.append(F.col("_share") == F.col("_k_share"))
    return dealt.join(repeated, matches, how).select(*rows.columns, *extra)


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join of two tables that share no columns but `on`, whose keys may have very many rows on both sides.

    Rows of a key that a side has more than `block_rows` of are dealt into blocks by the hash of the whole row, and each
    block of one side meets each of the other in a group of its own. A row is repeated once for every block of the other
    side, so only rows of such keys are. Null keys meet nothing. Both sides are read twice.
    """
    keys = list(on)
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select(*keys, F.lit(0), F.lit(1)))
    counted = sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    large = counted.where((F.greatest("_l", "_r") > block_rows) & (F.least("_l", "_r") > 0))
    blocks = materialize(large.select(
        *keys, *[F.ceil(F.col(s) / block_rows).cast("int").alias(f"_blocks{s}") for s in ("_l", "_r")]), "meetings")

    if not blocks.take(1):
        return left.join(right, keys)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        share = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"_blocks{own}", F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(f"_blocks{other}", F.lit(1)) - 1)
        return lookup(df, blocks, keys).select(*df.columns, share.alias(f"_block{own}"), F.explode(every).alias(f"_block{other}"))

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [*keys, "_block_l", "_block_r"]).drop("_block_l", "_block_r")
