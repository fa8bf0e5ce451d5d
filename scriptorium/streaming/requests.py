"""Request stream: summary requests arriving as files, answered per micro-batch.

The original application answers one request at a time, synchronously. Here
requests land as files (any Spark file format with a ``request_id`` column)
in a folder; a Structured Streaming query picks up new files and runs
get-or-create (A6) on each micro-batch with ``foreachBatch``. No operator keeps
state between batches: the answer store itself is the state, so a restart
resumes from the stream checkpoint and never recomputes a stored id. Each save
carries the stream's id and the epoch, so an epoch that is replayed after a lost
driver writes nothing that its first run wrote.

The stream checkpoint lives below ``spark.checkpoint.dir`` (a shared folder on
a cluster), so a lost driver or executor resumes where it stopped.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cache as ch
from ..session import ensure_checkpoint_dir
from ..sources.files import Folder

REQUEST_SCHEMA = T.StructType([T.StructField("request_id", T.StringType(), True)])


def request_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(folder)


def stream_id(spark: SparkSession, location: str) -> str:
    """The id that Spark gave the stream with this checkpoint; a new checkpoint has a new one."""
    return json.loads(Folder(spark, location).read("metadata") or "{}").get("id", location)


def epoch_handler(spark: SparkSession, store: ch.SummaryStore, articles: DataFrame, compute, location: str):
    """The ``foreachBatch`` function of ``serve_requests``; doing an epoch again has no effect."""

    def handle(batch: DataFrame, epoch_id: int) -> None:
        token = f"{stream_id(spark, location)}/{epoch_id}"
        done = f"_unknown/{hashlib.sha256(token.encode()).hexdigest()}"
        if store.folder.complete(done):  # written last
            return
        out = ch.get_or_create(store, batch, articles, compute, token)
        out["unknown"].withColumn("epoch", F.lit(epoch_id).cast("long")).write.mode("overwrite").parquet(
            f"{store.path}/{done}")

    return handle


def unknown_requests(spark: SparkSession, store: ch.SummaryStore) -> DataFrame:
    """``(request_id, epoch)`` of the requests that no article answers."""
    found = store.folder.names("_unknown")
    schema = "request_id string, epoch long"
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store.path}/_unknown/{n}" for n in found])


def serve_requests(spark: SparkSession, folder: str, store: ch.SummaryStore, articles: DataFrame,
                   compute, *, name: str = "summary-requests", fmt: str = "parquet",
                   available_now: bool = False, checkpoint: str | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``compute(request_ids_df) -> wide answers`` (for example a closure over
    ``pipeline.summarize``). Unknown ids are written next to the store, one folder an
    epoch, so they are reported (``unknown_requests``), not silently dropped.
    """
    location = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    handle = epoch_handler(spark, store, articles, compute, location)
    writer = (request_stream(spark, folder, fmt).writeStream
              .queryName(name)
              .option("checkpointLocation", location)
              .foreachBatch(handle))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
