"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.session import cut_lineage, scratch_path

__all__ = ["cut_lineage", "scratch_path", "table", "Query", "pair_blocks", "private_names", "attach"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private_names(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Working column names that no input column uses (names compare without case in Spark)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        new = name
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        found.append(new)
    return found


def pair_blocks(n: Column, member: Column, size: int) -> Column:
    """The block pairs a member of a group of n rows takes part in, as array<struct<lo, hi>>.

    A group is cut into ceil(n / size) blocks by a hash of the member. Every pair of blocks (and each
    block with itself) is one unit of work of about 2 * size rows, so a group of any size is spread
    over many tasks and each two members meet in exactly one unit.
    """
    blocks = F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(7)), blocks).cast("int")
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")),
    )


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, hot: int = 1000) -> DataFrame:
    """Inner join of rows with facts, a written table of one row a key whose weight is its number of rows.

    Keys with at least 1 / hot of all rows, of which there are hot at most, travel to the rows; no other key is large.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * hot >= max(total, 1)
    large = F.broadcast(facts.filter(heavy))
    small = rows.join(F.broadcast(facts.filter(heavy).select(key)), key, "left_anti").join(facts.filter(~heavy), key)
    return rows.join(large, key).unionByName(small)
