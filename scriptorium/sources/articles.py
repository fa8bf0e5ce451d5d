"""Article sources and sinks.

S1 ingest plan::

    binaryFile scan (recursive, *.xml)            -- one row per file, split by Spark; a group of folders at a time
      -> files over the size limit to the rejects   -- from the listing, unread
      -> mapInArrow: E1 text runs per file          -- per-row Python helper
      -> E3 join_runs / E4 require_fields           -- built-in expressions
      -> written once (fields + reason)             -- one parse feeds corpus and rejects
      -> corpus_id: range sort of (pmcid, path) alone, per-partition offsets
      -> ids joined back by path                    -- broadcast while small

Text never enters the range exchange, and no step pulls a partition into one task.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import broadcast_within, materialize, scratch_path, small_batches
from .files import Folder, folder_groups

RUNS_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("pmcid", T.ArrayType(T.StringType()), True),
    T.StructField("title", T.ArrayType(T.StringType()), True),
    T.StructField("abstract", T.ArrayType(T.StringType()), True),
    T.StructField("body_text", T.ArrayType(T.StringType()), True),
    T.StructField("error", T.StringType(), True),
])

CORPUS_SCHEMA = T.StructType([
    T.StructField("corpus_id", T.LongType(), False),
    T.StructField("pmcid", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("abstract", T.StringType(), False),
    T.StructField("body_text", T.StringType(), False),
])

PARSED_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    *CORPUS_SCHEMA.fields[1:],
    T.StructField("reason", T.StringType(), True),
])

DATA_TYPES = ("dataset", "embeddings")

#: What opening a small file counts, in bytes read.
OPEN_BYTES = 64 << 10
#: Bytes of documents that are parsed before their runs leave a task.
PARSE_BYTES = 4 << 20


@dataclass
class ScanResult:
    parsed: DataFrame    # path, the four fields, reason (null when kept)
    articles: DataFrame  # corpus_id, pmcid, title, abstract, body_text
    rejects: DataFrame   # path, reason


def parse_documents(docs: DataFrame, keep: list[str] | None = None,
                    path_col: str = "path", content_col: str = "content") -> DataFrame:
    """E1 on any ``(path, content BINARY)`` DataFrame: one runs row per document.

    Output: ``keep`` columns, ``path``, the four run lists and ``error``.
    Runs inside ``mapInArrow`` tasks; no shuffle.
    """
    keep = [c for c in (keep or []) if c not in (path_col, content_col)]
    parse = _parse_runs_factory()
    fields = ("pmcid", "title", "abstract", "body_text")
    keep_fields = [docs.schema[c] for c in keep]
    out_schema = T.StructType(keep_fields + list(RUNS_SCHEMA.fields))

    most = PARSE_BYTES

    def parsed(batch, pa):
        runs_cols = {f: [] for f in fields}
        errors = []
        for data in batch.column(content_col):
            runs, err = parse(data.as_py() or b"")
            errors.append(err)
            for f in fields:
                runs_cols[f].append(runs[f] if runs else None)
        arrays = [batch.column(c) for c in keep] + [batch.column(path_col)]
        arrays += [pa.array(runs_cols[f], pa.list_(pa.string())) for f in fields]
        arrays.append(pa.array(errors, pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=keep + ["path", *fields, "error"])

    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(content_col)), 0).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop, held = start, 0
                while stop < batch.num_rows and (stop == start or held + sizes[stop] <= most):
                    held += sizes[stop]
                    stop += 1
                yield parsed(batch.slice(start, stop - start), pa)
                start = stop

    taken = docs.select(*keep, F.col(path_col).alias("path"), F.col(content_col))
    return small_batches(taken).mapInArrow(fn, out_schema)


def finish_runs(runs: DataFrame) -> DataFrame:
    """E3 + E4 on parsed runs: the four joined fields and a ``reason`` (null when kept)."""
    extra = [c for c in runs.columns if c not in RUNS_SCHEMA.fieldNames()]
    fields = runs.select(*extra, "path", "error",
                         *[tx.join_runs(f).alias(f) for f in tx.ARTICLE_FIELDS])
    present = {f: tx.is_present(f) for f in tx.ARTICLE_FIELDS}
    missing = F.concat_ws(",", *[F.when(~present[f], F.lit(f)) for f in tx.ARTICLE_FIELDS])
    ok = None
    for f in tx.ARTICLE_FIELDS:
        ok = present[f] if ok is None else ok & present[f]
    reason = (F.when(F.col("error").isNotNull(), F.col("error"))
              .when(~ok, F.concat(F.lit("missing: "), missing)))
    return fields.withColumn("reason", reason).drop("error")


def _parse_runs_factory():
    """The E1 helper, registered to pickle by value: workers need no package install."""
    from pyspark import cloudpickle

    from ..functions import xml_runs

    cloudpickle.register_pickle_by_value(xml_runs)
    return xml_runs.parse_runs


def list_xml_files(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Every ``*.xml`` file below ``source``, one path or several (recursive): ``path, length, content``."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.xml")
            .load(source)
            .select("path", "length", "content"))


def file_limit(spark: SparkSession) -> int:
    """The longest file that ``binaryFile`` reads into one row."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))


def read_xml_files(spark: SparkSession, source: str, max_bytes: int | None = None,
                   listed: DataFrame | None = None) -> DataFrame:
    """``(path, content)`` of the files of at most ``max_bytes`` (default: what ``binaryFile`` reads).

    ``listed`` is ``list_xml_files(spark, source)`` where that was done before: listing takes long.
    """
    limit = file_limit(spark) if max_bytes is None else max_bytes
    return (list_xml_files(spark, source) if listed is None else listed).filter(F.col("length") <= limit).select("path", "content")


def oversized_files(spark: SparkSession, source: str, max_bytes: int | None = None,
                    listed: DataFrame | None = None) -> DataFrame:
    """``(path, reason)`` of the files above the limit; found in the listing, never read."""
    limit = file_limit(spark) if max_bytes is None else max_bytes
    return (list_xml_files(spark, source) if listed is None else listed).filter(F.col("length") > limit).select(
        "path", F.format_string("too long: %d bytes, at most %d are read", F.col("length"), F.lit(limit)).alias("reason"))


@contextmanager
def small_files(spark: SparkSession):
    """A file counts ``OPEN_BYTES`` more than it holds when scans are split in this block (Spark: 4 MB).

    With 4 MB, 32 files make a task however small they are, and starting tasks takes longer than reading.
    """
    name = "spark.sql.files.openCostInBytes"
    prior = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, prior)


def assign_ids(df: DataFrame, order_cols: list[str], id_col: str = "corpus_id",
               partitions: int | None = None) -> DataFrame:
    """Dense ids 0..n-1 in the order of ``order_cols``, computed in parallel.

    Range-partition and sort, cut the lineage (so every later use sees the same
    partitions), then id = offset of the partition + position in it. Offsets
    come from one row per partition; nothing is gathered into one task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.checkpoint(eager=True)
    mono = F.monotonically_increasing_id()
    with_pos = ranged.withColumn("_mono", mono).withColumn("_pid", F.shiftright("_mono", 33))
    counts = with_pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.fillna(0, subset=["_off"])
    out = with_pos.join(F.broadcast(offsets), "_pid").withColumn(
        id_col, (F.col("_off") + F.col("_mono") - F.shiftleft(F.col("_pid"), 33)).cast("long"))
    return out.drop("_mono", "_pid", "_off")


def number_articles(good: DataFrame) -> DataFrame:
    """``good`` with ``corpus_id``: dense, in the order of ``(pmcid, path)``.

    Only the two key columns go through the range exchange; the ids come back by
    ``path``, by a broadcast while they are small. ``good`` is read twice: pass a stored table.
    """
    keys = assign_ids(good.select("pmcid", "path"), ["pmcid", "path"])
    ids = materialize(keys.select("path", "corpus_id"), "article-ids")
    return good.join(broadcast_within(ids, F.octet_length("path") + 24), "path")


def scan_articles(spark: SparkSession, source: str, materialize_to: str | None = None,
                  max_file_bytes: int | None = None) -> ScanResult:
    """XML files below ``source`` -> article corpus plus a rejects table.

    The parse runs once: its output is written (to ``materialize_to`` or a
    folder below the shared checkpoint directory) and both outputs read it.
    A file of more than ``max_file_bytes`` is a reject, like a malformed one. The driver
    holds the listing of a group of folders at a time, not that of all files.
    """
    path, long_path = materialize_to or scratch_path(spark, "xml-parsed"), scratch_path(spark, "too-long")
    mode = "overwrite"
    for group in folder_groups(spark, source, ".xml"):
        listed = list_xml_files(spark, group)
        done = finish_runs(parse_documents(read_xml_files(spark, source, max_file_bytes, listed)))
        with small_files(spark):
            done.select(*PARSED_SCHEMA.fieldNames()).write.mode(mode).parquet(path)
            too_long = oversized_files(spark, source, max_file_bytes, listed)
            too_long.write.mode(mode).parquet(long_path)
        mode = "append"
    parsed = spark.read.schema(PARSED_SCHEMA).parquet(path)
    good = parsed.filter(F.col("reason").isNull())
    rejects = parsed.filter(F.col("reason").isNotNull()).select("path", "reason").unionByName(
        spark.read.schema(too_long.schema).parquet(long_path))
    articles = number_articles(good).select(*CORPUS_SCHEMA.fieldNames())
    return ScanResult(parsed=parsed, articles=articles, rejects=rejects)


def write_corpus(df: DataFrame, target: str, max_shard_bytes: int = 100 * 1024 * 1024,
                 mode: str = "errorifexists") -> None:
    """Write Parquet files of about ``max_shard_bytes`` each.

    AQE's rebalance splits or merges partitions to the advisory size, so file
    sizes follow the data rather than a fixed partition count.
    """
    spark = df.sparkSession
    prior = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(max_shard_bytes))
    try:
        df.hint("rebalance").write.mode(mode).parquet(target)
    finally:
        if prior is None:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        else:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", prior)


def data_path(root: str, dataset_name: str, data_type: str) -> str:
    """``{root}/{dataset_name}/{data_type}``; only ``dataset`` and ``embeddings`` exist."""
    if data_type not in DATA_TYPES:
        raise ValueError(f"no table of kind {data_type!r}; known are {', '.join(sorted(DATA_TYPES))}")
    return f"{root.rstrip('/')}/{dataset_name}/{data_type}"


def load_local(spark: SparkSession, root: str, dataset_name: str, data_type: str) -> DataFrame:
    """S3: read the stored corpus or its embeddings."""
    return spark.read.parquet(data_path(root, dataset_name, data_type))


def import_corpus(df: DataFrame, split: str | None = "train", split_col: str = "split") -> DataFrame:
    """Keep one split of an external dataset (any ``spark.read`` source), or all with None."""
    if split is None:
        return df
    if split_col not in df.columns:
        raise ValueError(f"no column {split_col!r} to take the split {split!r} from")
    return df.filter(F.col(split_col) == F.lit(split)).drop(split_col)


def lookup_articles(requests: DataFrame, articles: DataFrame,
                    fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """Requested ids against the corpus.

    ``(request_id, corpus_id, <fields>, found)``; an id with no article comes back
    with ``found = false`` instead of failing the batch.
    """
    arts = articles.select(F.col("pmcid").alias("request_id"), "corpus_id", *fields)
    return (requests.select("request_id").join(arts, "request_id", "left")
            .withColumn("found", F.col("corpus_id").isNotNull()))


def load_or_create_embeddings(spark: SparkSession, root: str, dataset_name: str, build) -> DataFrame:
    """Read stored embeddings, or compute them with ``build()`` and store them first.

    A folder left half-written by a lost driver is built anew.
    """
    path = data_path(root, dataset_name, "embeddings")
    if not Folder(spark, path).complete():
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
