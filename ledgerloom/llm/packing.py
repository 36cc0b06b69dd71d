"""Texts packed into pieces of a few megabytes, bucketed on disk by piece.

A piece is one row; whatever is worked out about it elsewhere is joined back by
its number where it lies, so the texts are shuffled once, however many passes follow.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, workspace

BUCKETS = 20_000  # at most, whatever the number of pieces: a bucket then has several


def buckets_of(spark: SparkSession, wanted: int) -> int:
    return max(1, min(wanted, BUCKETS, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))


def save(df: DataFrame, buckets: int, key: str, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """`df`, dealt by `key` already, as a bucketed table, and what drops it with its files."""
    spark = df.sparkSession
    name, path = f"ledgerloom_{label}_{uuid.uuid4().hex}", workspace(spark, label)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)

    def drop():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(spark, path)

    return spark.table(name), drop


class Pieces:
    """The bucketed table, its number of buckets, and what drops it once results are written."""

    def __init__(self, table: DataFrame, buckets: int, drop: Callable[[], None]):
        self.table, self.buckets, self.drop = table, buckets, drop

    def with_answers(self, answers: DataFrame, column: str) -> DataFrame:
        """The pieces with answers ARRAY<STRUCT<shard, column>>; null for a piece that got none. Only the answers move."""
        got = answers.repartition(self.buckets, "piece").groupBy("piece").agg(F.collect_list(F.struct("shard", column)).alias("answers"))
        return self.table.join(got.hint("shuffle_hash"), "piece", "left")


def pack(rows: DataFrame, pieces: int, make, schema: str, chosen: DataFrame | None = None) -> Pieces:
    """One row for each piece, of make(frame), or make(frame, the chosen rows) where given; both have a column piece."""
    buckets = buckets_of(rows.sparkSession, pieces)
    dealt = rows.repartition(buckets, "piece").groupBy("piece")
    if chosen is None:
        made = dealt.applyInPandas(make, schema)
    else:
        made = dealt.cogroup(chosen.repartition(buckets, "piece").groupBy("piece")).applyInPandas(make, schema)
    table, drop = save(made, buckets, "piece", "pieces")
    return Pieces(table, buckets, drop)


def one_row(**columns) -> pd.DataFrame:
    return pd.DataFrame({k: [v] for k, v in columns.items()})
