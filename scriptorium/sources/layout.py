"""A corpus laid out by its key, so that a lookup reads few files and row groups.

``write_keyed`` puts the rows in directories by a hash bucket of the key, sorted by key
within, with a Parquet Bloom filter on the key. A lookup then reads the buckets of its
requests only: of a few requests by literal filters (which also skip row groups by their
statistics and Bloom filters), of many by dynamic partition pruning from the broadcast
request table, and beyond the broadcast limit by a shuffled join on (bucket, key).

The bucket count is part of the path (``of=64/bucket=7/...``), so readers need no other
record, and a corpus can be laid out anew with another count beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, broadcast_within, materialize
from .files import Folder

BUCKETS = 64
ROW_GROUP_BYTES = 16 << 20
#: Up to so many requested keys become literals of the scan's filter.
FEW_KEYS = 1000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, key: str = "pmcid", buckets: int = BUCKETS,
                row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Write ``rows`` by hash bucket of ``key``.

    The range exchange by (bucket, key, row code) splits a bucket, and even the rows of one
    key, over tasks where they are many, so no task writes more than its share; a bucket
    has one file, or a few next to each other in key order.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    if {"bucket", "of"} & set(rows.columns):
        raise ValueError("the columns 'bucket' and 'of' name the directories")
    out = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    order = ["bucket", key, F.xxhash64(*rows.columns)]
    (out.repartitionByRange(*order).sortWithinPartitions("bucket", key)
     .write.mode(mode).partitionBy("bucket")
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", str(row_group_bytes))
     .parquet(f"{path.rstrip('/')}/of={buckets}"))


class KeyedCorpus:
    """A corpus written by ``write_keyed``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "pmcid"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        counts = [int(n.split("=", 1)[1]) for n in Folder(spark, self.path).names() if n.startswith("of=")]
        if not counts:
            raise ValueError(f"no keyed corpus at {path}")
        self.buckets = max(counts)

    def _scan(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/of={self.buckets}")

    def read(self) -> DataFrame:
        """All rows, without the bucket."""
        return self._scan().drop("bucket")

    def matching(self, keys: DataFrame, key_col: str) -> DataFrame:
        """The rows whose key occurs in ``keys`` (distinct, stored)."""
        rows = self._scan()
        few = keys.select(key_col).limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            values = [r[0] for r in few if r[0] is not None]
            if not values:
                return rows.limit(0).drop("bucket")
            at = keys.filter(F.col(key_col).isNotNull()).select(bucket_of(F.col(key_col), self.buckets)).distinct()
            places = [r[0] for r in at.collect()]  # at most FEW_KEYS
            return rows.filter(F.col("bucket").isin(places) & F.col(self.key).isin(values)).drop("bucket")
        # The comparison tells Spark that this side is selective, so that it prunes the scan by it.
        wanted = keys.filter(F.length(F.col(key_col).cast("string")) > 0).select(
            F.col(key_col).alias(self.key), bucket_of(F.col(key_col), self.buckets).alias("bucket"))
        wanted = broadcast_within(wanted, F.octet_length(F.col(self.key).cast("string")) + 32, BROADCAST_BYTES)
        return rows.join(wanted, ["bucket", self.key], "left_semi").drop("bucket")

    def lookup(self, requests: DataFrame, fields: tuple[str, ...] = ("title",),
               request_col: str = "request_id") -> DataFrame:
        """S5 on this layout: ``(request_id, corpus_id, <fields>, found)``, a row per request and article.

        A request that occurs several times comes back as often; one without an
        article (or a null one) has ``found = false``.
        """
        keys = materialize(requests.select(F.col(request_col).alias("_key")).filter("_key is not null").distinct(),
                           "lookup-keys")
        rows = self.matching(keys, "_key").select(F.col(self.key).alias("_key"), "corpus_id", *fields)
        return (requests.select(F.col(request_col).alias("request_id"), F.col(request_col).alias("_key"))
                .join(rows, "_key", "left").drop("_key").withColumn("found", F.col("corpus_id").isNotNull()))
