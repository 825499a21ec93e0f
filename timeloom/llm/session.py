"""What the operators share on the Spark side: tables, checkpoints and connected components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.plans.materialise import checkpointed

__all__ = ["checkpointed", "connected_components", "fold_column", "fold_of", "numbered", "salted_join", "short_shuffles", "small", "table"]

#: A table of keys that is no longer than this is given to every task; a longer one is joined by a shuffle.
BROADCAST = 100_000
#: Rows of one key from which it is dealt to several tasks, and how many of them each gets.
HOT, SALTED = 65_536, 16_384
#: Where the numbers of rows begin that their id doesn't tell apart: ids are taken to be below.
UNNAMED = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that every task gets, if it is short enough."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def numbered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``__row``: the id, or for rows without one, and for ids that have several texts, a number made of id and text."""
    digest = F.xxhash64(text_column)
    several = docs.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("__several")).agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    several = checkpointed(several.where("a <> b").select("__several"))
    number = F.lit(UNNAMED) + F.xxhash64(id_column, text_column).bitwiseAND(F.lit(UNNAMED - 1))
    joined = docs.join(small(several), F.col(id_column) == F.col("__several"), "left")
    return joined.withColumn("__row", F.when(F.col(id_column).isNull() | F.col("__several").isNotNull(), number).otherwise(F.col(id_column).cast("long"))).drop("__several")


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], salt_by: str) -> DataFrame:
    """``rows`` joined with the checkpointed ``keys``, which have a row for each of some values of ``on`` and the number ``n`` of
    rows with it: values with more than HOT rows are dealt to tasks by SALTED rows or so, by the hash of ``salt_by``."""
    salts = F.when(F.col("n") > HOT, F.ceil(F.col("n") / SALTED)).otherwise(1).cast("int")
    hot = small(keys.where(F.col("n") > HOT).select(*on, salts.alias("__salts")))
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt_by), F.col("__salts"))).cast("int")
    salted = rows.join(hot, on, "left").withColumn("__salt", salt).drop("__salts")
    dealt = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return salted.join(dealt, [*on, "__salt"]).drop("__salt")


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when the action ends, instead of when the driver happens to collect its
    garbage; long jobs of several steps would fill the executors' disks meanwhile. Steps hand on checkpointed tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fold_of(doc_id: int) -> int:
    """The remainder that splits rows into folds: crc32 of the id as text, modulo 3."""
    return zlib.crc32(str(doc_id).encode()) % 3


def fold_column(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach: columns ``node``, ``component``.

    Alternating large-star and small-star rounds over the edge table; every round keeps only counts and minima per
    node, so no adjacency list is gathered, and the tables are checkpointed so that lost executors cost one round.
    The number of rounds grows with the logarithm of the longest path. Null ends and self-loops are ignored; an empty
    edge table gives an empty result.
    """
    current = checkpointed(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u is not null and v is not null and u <> v and u > v")
        .distinct()
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        current = checkpointed(small)
        state = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    labels = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)
