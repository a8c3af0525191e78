"""File sources and sinks.

Paths may be any Hadoop-compatible URI; file renames and listings go
through the Hadoop FileSystem API, never the local file system, so the same
code works on shared cluster storage.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moldwatch.functions import utc_timestamp
from moldwatch.session import ensure_utc

RAW_TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("variable_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("machine_definition", T.StringType()),
])

LIVE_MESSAGE_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("variable_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_telemetry_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_TELEMETRY_SCHEMA,
                       pattern: str = "*.csv") -> DataFrame:
    """CSV telemetry, one or more files per machine (S1): explicit schema
    (no inference pass), machine id = file stem before the first '-',
    upper-cased.  Files are split by the reader, not per machine."""
    ensure_utc(spark)
    df = (spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern)
          .option("recursiveFileLookup", True).csv(path))
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return df.select("*", F.upper(F.split(stem, "-").getItem(0)).alias("machine_id"))


_CSV_CELL = r',("(?:[^"\\\\]|\\\\.|"")*"|[^,]*)'


def _csv_cells(line: Column) -> Column:
    """The cells of a CSV line, outer quotes removed, names and values trimmed."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CSV_CELL), F.lit(1))
    bare = lambda c: F.regexp_replace(F.trim(c), r'^"|"$', "")
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(bare(c), r'\\"|""', '"')))


def csv_file_coverage(spark: SparkSession, path: str, time_part: str = "time", pattern: str = "*.csv") -> DataFrame:
    """Per CSV file below ``path`` (A17): source_file, first_ts, last_ts, rows, n_columns and columns, from the
    file's own header, so files of different columns may lie side by side.

    The time column is the first whose name holds ``time_part`` in any case; a file without one has null times, as
    have times that cannot be parsed.  A header is the first line of its file; blank lines and the
    header are no rows.  A file without any line has no row here.  Records are lines: a cell holds no line break.
    Lines are scanned as text by all tasks, files split as usual; the headers (one row a file) are joined to them."""
    ensure_utc(spark)
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))
    heads = (lines.where("start = 0").withColumn("at", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "at").alias("head"))
             .select("file", _csv_cells(F.regexp_replace("head", "^\ufeff", "")).alias("columns")))
    heads = heads.withColumn("place", F.array_position(
        F.transform("columns", lambda c: F.contains(F.lower(c), F.lit(time_part.lower()))), True))
    cell = F.when(F.col("place") > 0, F.get(_csv_cells(F.col("value")), (F.col("place") - 1).cast("int")))
    x = lines.where(F.trim("value") != "").join(heads.select("file", "place"), "file") \
        .select("file", utc_timestamp(cell).alias("ts"))
    found = x.groupBy("file").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                  (F.count(F.lit(1)) - 1).alias("rows"))
    return found.join(heads, "file").select(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("source_file"), "first_ts", "last_ts", "rows",
        F.size("columns").alias("n_columns"), "columns")


def read_production_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Production-log export (S3; Excel itself is not read): header names
    trimmed, office lock files ('~$*') skipped."""
    ensure_utc(spark)
    r = spark.read.option("pathGlobFilter", "[!~]*").option("recursiveFileLookup", True)
    if fmt == "csv":
        df = r.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = r.format(fmt).load(path)
    return df.toDF(*[c.strip() for c in df.columns])


def typed_production_log(df: DataFrame) -> DataFrame:
    """Cast an exported log to the operator types (bad values -> NULL)."""
    return df.select(
        F.col("machine_event_record_id").try_cast("long").alias("machine_event_record_id"),
        F.col("machine_id"),
        F.col("machine_event_create_date").try_cast("timestamp").alias("machine_event_create_date"),
        F.col("machine_event_create_time").try_cast("int").alias("machine_event_create_time"),
        F.col("machine_status_code").try_cast("int").alias("machine_status_code"),
        F.col("scrap_quantity").try_cast("int").alias("scrap_quantity"),
        F.col("yield_quantity").try_cast("int").alias("yield_quantity"),
        F.col("event_end").try_cast("timestamp").alias("event_end"))


def write_per_machine_csv(df: DataFrame, path: str, machine_col: str = "machine_id",
                          suffix: str = "telemetry") -> None:
    """CSV sink with one file set per machine named ``{machine}-{suffix}-N.csv``
    (S8 + the naming S1 reads).  One write job, the rows of a machine ranged by
    their digest over several tasks, then metadata renames through the Hadoop FS API."""
    tmp = path.rstrip("/") + "/_staging"
    _spread(df, [machine_col]).write.mode("overwrite").option("header", True) \
        .partitionBy(machine_col).csv(tmp)
    fs, root = _fs(df.sparkSession, tmp)
    jvm = df.sparkSession.sparkContext._jvm
    for d in fs.listStatus(root):
        if not d.isDirectory():
            continue
        machine = d.getPath().getName().split("=", 1)[1]
        for i, f in enumerate(x for x in fs.listStatus(d.getPath()) if x.getPath().getName().endswith(".csv")):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{machine}-{suffix}-{i}.csv"))
    fs.delete(root, True)


ROWS_PER_FILE = 5_000_000


def _spread(df: DataFrame, cols) -> DataFrame:
    """Rows ranged by ``cols`` and a row digest: the rows of one value stay together as far as
    they fit, and a value with most of all rows is dealt over many tasks."""
    digest = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.withColumn("_d", digest).repartitionByRange(*cols, "_d").drop("_d")


def write_partitioned(df: DataFrame, path: str, partition_cols=("machine_id",), mode: str = "overwrite",
                      compression: str = "snappy") -> None:
    """Parquet sink partitioned by machine (and e.g. split) (S7, S10, S11):
    readers prune partitions from ``machine_id = ...`` / ``split = ...``.  Hot values
    are written by several tasks, ROWS_PER_FILE rows a file."""
    (_spread(df, partition_cols).write.mode(mode).option("compression", compression)
     .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*partition_cols).parquet(path))


def write_json_dimension(df: DataFrame, path: str) -> None:
    """Dimension / metrics record as JSON lines (S6, ML7)."""
    df.write.mode("overwrite").json(path)


def read_json_dimension(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_live_messages(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Live readings as a JSON file stream (S9): one JSON object per reading,
    parsed with an explicit schema; value coerced (P1), time parsed (P2)."""
    from moldwatch.functions import normalize_machine_id, to_number, utc_timestamp
    s = spark.readStream.schema(LIVE_MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return s.select(normalize_machine_id("machine_id").alias("machine_id"), "variable_name",
                    to_number("value").alias("value"), utc_timestamp("timestamp").alias("timestamp"))


def parse_live_messages(raw: DataFrame, col: str = "value") -> DataFrame:
    """Message bus payloads (e.g. a Kafka ``value`` column) -> readings."""
    from moldwatch.functions import normalize_machine_id, to_number, utc_timestamp
    j = F.from_json(F.col(col).cast("string"), LIVE_MESSAGE_SCHEMA)
    x = raw.select(j.alias("m")).select("m.*")
    return x.select(normalize_machine_id("machine_id").alias("machine_id"), "variable_name",
                    to_number("value").alias("value"), utc_timestamp("timestamp").alias("timestamp"))


def judged_messages(raw: DataFrame, col: str = "value") -> DataFrame:
    """Message payloads -> message, the reading's columns, and ``reason``: null for a reading, else why
    there is none (unreadable JSON, no machine, no sensor, no time, no numeric value)."""
    from moldwatch.functions import normalize_machine_id, to_number, utc_timestamp
    corrupt = "_corrupt"
    schema = T.StructType([*LIVE_MESSAGE_SCHEMA.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    text = F.col(col).cast("string")
    x = raw.select(text.alias("message"), F.from_json(text, schema, options).alias("m"))
    blank = lambda c: F.coalesce(F.trim(F.col(f"m.{c}")) == "", F.lit(True))
    value, ts = to_number("m.value"), utc_timestamp("m.timestamp")
    reason = (F.when(F.col("m").isNull() | F.col(f"m.{corrupt}").isNotNull(), "unreadable").when(blank("machine_id"), "no machine")
              .when(blank("variable_name"), "no sensor").when(ts.isNull(), "no time").when(value.isNull(), "no value"))
    return x.select("message", normalize_machine_id("m.machine_id").alias("machine_id"), F.col("m.variable_name").alias("variable_name"),
                    value.alias("value"), ts.alias("timestamp"), reason.alias("reason"))


def ingest_messages(raw: DataFrame, path: str, col: str = "value"):
    """Streaming ingest of live messages (S9): one pass per micro-batch writes readings below
    ``path``/readings and what is none, with its reason, below ``path``/quarantine.  A batch replaces its
    own partition, so a batch that is run again after a failure leaves no row twice.
    Runs what is there and returns."""
    def both(batch: DataFrame, number: int):
        x = judged_messages(batch, col).withColumn("batch", F.lit(number)).persist()
        try:
            for name, part in (("readings", x.where("reason IS NULL").drop("message", "reason")),
                               ("quarantine", x.where("reason IS NOT NULL").select("message", "reason", "batch"))):
                part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        finally:
            x.unpersist()

    query = raw.writeStream.foreachBatch(both).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def append_metrics(record: DataFrame, path: str, model: str, version: str) -> None:
    """Add a metrics record (ML7) as JSON lines, kept by model and version; a version written again replaces
    itself and no other."""
    (record.withColumn("model", F.lit(model)).withColumn("version", F.lit(version)).withColumn("created_at", F.current_timestamp())
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "version").json(path))


def latest_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Each model's record with the newest ``created_at``; ``schema``: that of the appended records."""
    kept = T.StructType([*schema.fields, T.StructField("created_at", T.TimestampType()), T.StructField("model", T.StringType()),
                         T.StructField("version", T.StringType())])
    x = spark.read.schema(kept).json(path)
    names = [f.name for f in kept]
    newest = F.max_by(F.struct(*names), F.struct("created_at", "version"))
    return x.groupBy("model").agg(newest.alias("r")).select("r.*")
