"""Reproducible splits per group, and the mixing of data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.session import written

#: 0.2 of the records that 0.7 and 0.2 leave, as floats divide.
VALIDATION_OF_REST = 0.2 / (0.7 + 0.2)


def rank_by_hash(rows: DataFrame, group: str, key: Column, digits: int = 3) -> DataFrame:
    """rows with _rank, from 1 within the group in the order of the key's MD5, and _n, the group's size.

    A task orders one group's share of a hash prefix; only counts are carried from
    prefix to prefix, so a group that holds a third of all rows is spread.
    """
    hashed = rows.withColumn("_hash", F.md5(key)).withColumn("_part", F.substring("_hash", 1, digits))
    counts = hashed.groupBy(group, "_part").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(group)
    before = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("_n"))
    ranked = hashed.withColumn("_here", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_hash")))
    return ranked.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_before") + F.col("_here")).drop("_group", "_p", "_part", "_before", "_here", "_hash")


def stratified_split(rows: DataFrame, group: str, key: Column, min_group: int = 5) -> DataFrame:
    """rows with split: within each group a tenth (rounded up) test, two ninths of the rest (rounded up) validation, all else train.

    Groups of fewer than ``min_group`` rows are all train. Members go by the hash of
    their key, which has to be unique; null is a group too.
    """
    test = F.ceil(F.col("_n") * 0.1)
    validation = F.ceil((F.col("_n") - test) * F.lit(VALIDATION_OF_REST))
    split = F.when(F.col("_n") < min_group, "train").when(F.col("_rank") <= test, "test").when(F.col("_rank") <= test + validation, "validation").otherwise("train")
    return rank_by_hash(rows, group, key).withColumn("split", split).drop("_rank", "_n")


def first_rows(rows: DataFrame, order: Column, count: int) -> DataFrame:
    """The first ``count`` rows by an order; fails if there are fewer."""
    taken = written(rows.orderBy(order).limit(count))
    n = taken.count()
    if n < count:
        raise ValueError(f"{count} rows wanted, {n} found")
    return taken


def mix_datasets(parts: list[DataFrame], seed: int, key: Column, limit: int | None = None) -> DataFrame:
    """All parts together, in an order that depends on the seed only; with limit, the first so many rows of each part by key, of which there have to be as many."""
    whole = reduce(DataFrame.unionByName, parts if limit is None else [first_rows(p, key, limit) for p in parts])
    return whole.orderBy(F.md5(F.concat(key.cast("string"), F.lit(str(seed)))))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the values of its last row, the place of its first."""
    values = F.struct(*[F.col(c) for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.max_by(values, F.col(order)).alias("_v"), F.min(order).alias(order)).select(key, order, "_v.*")


def with_values(rows: DataFrame, lookup: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of lookup by key, of equal keys the last by order; fails if a key isn't there."""
    found = written(rows.join(last_by_key(lookup, key, order).drop(order).withColumn("_there", F.lit(1)), key, "left"))
    missing = found.where("_there is null").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"no value for {[r[0] for r in missing]}")
    return found.drop("_there")


def case_keys(rows: DataFrame, *order: str, name: str = "case_id") -> DataFrame:
    """rows with case1, case2, ... in a total order; a column of that name is replaced."""
    return row_index(rows.drop(name), *order, name="_place").withColumn(name, F.concat(F.lit("case"), F.col("_place") + 1)).drop("_place")


def row_index(rows: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """rows with their place, from 0, in a total order. Rows are sorted by range over all tasks; only the count of each range is carried on."""
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + (F.col("_at") - F.shiftleft("_part", 33))).drop("_part", "_at", "_before")
