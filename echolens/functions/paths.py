"""Topic paths ``L1/L2/L3``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def segment(path: Column, level: str) -> Column:
    """Level segment by plain split; L3 is everything from the third part on."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    if level == "L1":
        return F.element_at(parts, 1)
    if level == "L2":
        return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2))).otherwise(F.element_at(parts, 1))
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/")).otherwise(F.element_at(parts, -1))


def path_of(l1: Column, l2: Column, l3: Column) -> Column:
    """A label that holds a slash already carries its second level."""
    return F.when(F.contains(l3, F.lit("/")), F.concat_ws("/", l1, l3)).otherwise(F.concat_ws("/", l1, l2, l3))


def path_dim(tax: DataFrame) -> DataFrame:
    return tax.select(path_of(F.col("l1"), F.col("l2"), F.col("l3")).alias("full_path"), "l1", "l2", "l3", "ord")


def resolve_paths(df: DataFrame, tax: DataFrame, path: str = "full_path") -> DataFrame:
    """C4: exact taxonomy lookup first, else split of three or two parts, else NULL levels.

    The taxonomy is a configuration table, so Catalyst broadcasts it on its size.
    """
    dim = path_dim(tax).select(F.col("full_path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in ("l1", "l2", "l3")))
    parts = F.split(F.col(path), "/")
    n = F.size(parts)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    known = F.col("_path").isNotNull()
    return (
        df.join(dim, F.col(path) == F.col("_path"), "left")
        .withColumn("l1", F.when(known, F.col("_l1")).when(n.isin(2, 3), part(1)))
        .withColumn("l2", F.when(known, F.col("_l2")).when(n.isin(2, 3), part(2)))
        .withColumn("l3", F.when(known, F.col("_l3")).when(n == 3, part(3)).when(n == 2, part(2)))
        .drop("_path", "_l1", "_l2", "_l3")
    )


def level_column(df: DataFrame, level: str, tax: DataFrame | None = None) -> DataFrame:
    """Add ``topic``: by split (default, compatible), or exact when a taxonomy is given."""
    if tax is None:
        return df.withColumn("topic", segment(F.col("full_path"), level))
    return resolve_paths(df, tax).withColumn("topic", F.col(level.lower())).drop("l1", "l2", "l3")
