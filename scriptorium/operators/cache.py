"""Keyed answer store (S9) and get-or-create over a request batch.

Each save is a Parquet folder ``batch=N``; a read resolves a key to its row from the
highest batch. Any number of writers may save at once: rows are written to a folder of
their own, the number N is claimed by creating a file that only one writer can create,
and the folder becomes visible by one rename. A writer that dies leaves a hidden folder
and perhaps an unused number, never a half-read batch. A save with a token (a stream's
query and epoch) that was made before writes nothing.

``compact`` merges what is visible into a new folder ``base=N``, laid out by key (see
``sources.layout``), that names the batches it covers; readers use the newest base and
the batches it does not cover, so saves and reads go on meanwhile, and a lookup of some
keys reads their buckets of the base only. ``vacuum`` deletes what the base replaced.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..sources import config as cfg
from ..sources.files import Folder
from ..sources.layout import BUCKETS, KeyedCorpus, write_keyed

STORE_KEY = "pmc_id"


def store_schema(audiences: dict[str, str] | None = None) -> T.StructType:
    keys = list((audiences or cfg.AUDIENCES).keys())
    return T.StructType([T.StructField(STORE_KEY, T.StringType(), False)] +
                        [T.StructField(f"{k}_summary", T.StringType(), True) for k in keys])


class SummaryStore:
    """Answers keyed by ``pmc_id`` with one text column per audience."""

    def __init__(self, spark: SparkSession, path: str, audiences: dict[str, str] | None = None,
                 buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = store_schema(audiences)
        self.buckets = buckets
        self.folder = Folder(spark, self.path)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split("=", 1)[1]) for n in self.folder.names() if n.startswith(f"{kind}="))

    def _visible(self) -> tuple[int | None, list[int], set[int]]:
        """The newest base, the batches it does not cover, and those it covers."""
        base = max(self._numbers("base"), default=None)
        text = self.folder.read(f"base={base}/_covers") if base is not None else None
        covered = {int(n) for n in (text or "").split()}
        return base, [n for n in self._numbers("batch") if n not in covered], covered

    def _raw_schema(self) -> T.StructType:
        return T.StructType(list(self.schema.fields) + [T.StructField("batch", T.LongType())])

    def raw(self, wanted: DataFrame | None = None) -> DataFrame:
        """Saved rows with their batch, also outdated ones; of the keys ``wanted (pmc_id)`` at least."""
        base, batches, _ = self._visible()
        schema = self._raw_schema()
        parts = []
        if base is not None:
            merged = KeyedCorpus(self.spark, f"{self.path}/base={base}", STORE_KEY)
            rows = merged.read() if wanted is None else merged.matching(wanted, STORE_KEY)
            parts.append(rows.select(*schema.fieldNames()))
        if batches:
            parts.append(self.spark.read.schema(schema).option("basePath", self.path).parquet(
                *[f"{self.path}/batch={n}" for n in batches]).select(*schema.fieldNames()))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def keys(self, wanted: DataFrame | None = None) -> DataFrame:
        """Stored keys only: reads one column, enough for hit / miss tests."""
        return self.raw(wanted).select(STORE_KEY).distinct()

    def _latest(self, raw: DataFrame) -> DataFrame:
        values = [c for c in self.schema.fieldNames() if c != STORE_KEY]
        latest = raw.groupBy(STORE_KEY).agg(F.max(F.struct("batch", *values)).alias("_v"))
        return latest.select(STORE_KEY, *[F.col(f"_v.{c}").alias(c) for c in values], F.col("_v.batch").alias("batch"))

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """One row per key: the latest saved version (of rows of one save the greatest).

        ``wanted (pmc_id)``, distinct and stored, restricts the result to these keys.
        """
        rows = self._latest(self.raw(wanted)).drop("batch")
        return rows if wanted is None else rows.join(wanted.select(STORE_KEY), STORE_KEY, "left_semi")

    def _claim(self) -> int:
        taken = [int(n) for n in self.folder.names("_claims")]
        n = max([*taken, *self._numbers("batch"), *self._numbers("base")], default=0) + 1
        while not self.folder.create(f"_claims/{n}"):
            n += 1
        return n

    def _saved_as(self, token: str | None) -> tuple[str, int | None]:
        name = f"_tokens/{hashlib.sha256((token or '').encode()).hexdigest()}"
        text = self.folder.read(name) if token is not None else None
        return name, int(text) if text else None

    def was_saved(self, token: str) -> bool:
        """Whether a save with this token is visible (or was merged)."""
        _, n = self._saved_as(token)
        return n is not None and (self.folder.exists(f"batch={n}") or n in self._visible()[2])

    def save(self, rows: DataFrame, token: str | None = None) -> int:
        """Append rows as a new batch; returns its number.

        With a ``token`` that was saved before, nothing is computed or written.
        """
        name, n = self._saved_as(token)
        if token is not None and self.was_saved(token):
            return n
        staged = f"_staging/{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.mode("errorifexists").parquet(f"{self.path}/{staged}")
        if n is None:
            n = self._claim()
            if token is not None:
                self.folder.write(name, str(n))
        self.folder.publish(staged, f"batch={n}")
        return n

    def compact(self) -> int | None:
        """Merge what is visible into a new base by key; returns its number (None: nothing to merge)."""
        base, batches, covered = self._visible()
        if not batches:
            return base
        staged = f"_staging/{uuid.uuid4().hex}"
        write_keyed(self._latest(self.raw()), f"{self.path}/{staged}", STORE_KEY, self.buckets)
        self.folder.write(f"{staged}/_covers", " ".join(map(str, sorted(covered | set(batches)))))
        n = self._claim()
        self.folder.publish(staged, f"base={n}")
        return n

    def vacuum(self) -> int:
        """Delete the batches and bases that the newest base replaced; returns how many folders went.

        A reader that planned before the last ``compact`` may still read them: wait for it.
        """
        base, _, covered = self._visible()
        old = [f"batch={n}" for n in self._numbers("batch") if n in covered]
        old += [f"base={n}" for n in self._numbers("base") if n != base]
        for name in old:
            self.folder.delete(name)
        return len(old)


def clean_requests(requests: DataFrame, col: str = "request_id") -> DataFrame:
    """Drop null and empty ids (an id of spaces is kept and looked up), then distinct."""
    return (requests.select(F.col(col).cast("string").alias("request_id"))
            .filter(F.col("request_id").isNotNull() & (F.length("request_id") > 0))
            .distinct())


def plan_requests(requests: DataFrame, stored_keys: DataFrame, articles: DataFrame) -> DataFrame:
    """A6 planning: ``(request_id, status)`` with status ``cached``, ``compute`` or ``unknown``.

    One pass: the distinct requests are left-joined to the distinct stored keys
    and to the distinct corpus ids (key columns only), and the status is read
    from which side matched.
    """
    reqs = clean_requests(requests)
    keys = stored_keys.select(F.col(STORE_KEY).alias("request_id")).distinct().withColumn(
        "_cached", F.lit(True))
    known = articles.select(F.col("pmcid").alias("request_id")).distinct().withColumn(
        "_known", F.lit(True))
    joined = reqs.join(keys, "request_id", "left").join(known, "request_id", "left")
    status = (F.when(F.col("_cached").isNotNull(), F.lit("cached"))
              .when(F.col("_known").isNotNull(), F.lit("compute"))
              .otherwise(F.lit("unknown")))
    return joined.select("request_id", status.alias("status"))


def get_or_create(store: SummaryStore, requests: DataFrame, articles: DataFrame, compute,
                  token: str | None = None) -> dict:
    """Serve cached ids from the store, compute the rest once, save them.

    ``compute(request_ids_df) -> wide answers (pmc_id, <audience>_summary...)``.
    Returns ``{"plan", "answers", "unknown", "missing"}`` DataFrames; ``answers`` covers
    every cached and newly computed id. A computed row without any answer is not
    stored, so that it is tried again; its id, and one that ``compute`` left out, is ``missing``.
    A batch repeated with the same ``token`` stores nothing again. Two batches at once may
    compute the same id; both rows are kept, and the later save is read.
    """
    ids = clean_requests(requests).select(F.col("request_id").alias(STORE_KEY))
    ids = materialize(ids, "requested-ids")
    plan = plan_requests(requests, store.keys(ids), articles).checkpoint(eager=True)
    todo = plan.filter(F.col("status") == "compute").select("request_id")
    if todo.limit(1).count() > 0:
        answered = F.coalesce(*[F.col(c) for c in store.schema.fieldNames() if c != STORE_KEY])
        store.save(compute(todo).filter(answered.isNotNull()), token)
    wanted = plan.filter(F.col("status") != "unknown").select(F.col("request_id").alias(STORE_KEY))
    wanted = materialize(wanted, "known-ids")
    answers = store.read(wanted)
    unknown = plan.filter(F.col("status") == "unknown").select("request_id")
    missing = wanted.join(store.keys(wanted), STORE_KEY, "left_anti").withColumnRenamed(STORE_KEY, "request_id")
    return {"plan": plan, "answers": answers, "unknown": unknown, "missing": missing}
