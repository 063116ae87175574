"""File sources and sinks.

Layouts of the source application:
  <root>/<client>/<date>/raw*        bid-change CSV parts (header row)
  model_eval_<yyyy-MM-dd>.csv        one model evaluation file per day
  site_config.json                   JSON array of client records
  complaints CSV                     quoted, multi-line free text
  documents                          one text file per document
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_EVAL_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("model_id", T.StringType()),
    T.StructField("short_name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("ud", T.StringType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("vi", T.StringType()), T.StructField("training", T.StringType()),
    T.StructField("testing", T.StringType()), T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
])

SITE_CONFIG_SCHEMA = T.StructType([
    T.StructField("short_name", T.StringType()), T.StructField("site_id", T.LongType()),
    T.StructField("percent_prediction_threshold", T.DoubleType()),
])

# a bid part file: <root>/<client>/<date>/raw*[/<part>]
BID_PATH = r"/([^/]+)/([^/]+)/(raw[^/]*)(/[^/]+)?$"


# ------------------------------------------------------------------ S4

def model_eval_path(folder: str, as_of) -> str:
    d = as_of if isinstance(as_of, str) else date.isoformat(as_of)
    return f"{folder}/model_eval_{d}.csv"


def read_model_eval(spark: SparkSession, folder: str, as_of) -> DataFrame:
    """The evaluation file of day ``as_of`` (explicit schema, header row)."""
    rows = (spark.read.schema(MODEL_EVAL_SCHEMA).option("header", True)
            .option("quote", '"').option("escape", '"')
            .csv(model_eval_path(folder, as_of)))
    return rows.withColumn("rmse", F.nanvl("rmse", F.lit(None).cast("double")))


# ------------------------------------------------------------------ S6, S7

def list_bid_partitions(spark: SparkSession, root: str) -> DataFrame:
    """(client, date) of every folder holding ``raw*`` parts. Only file
    listings are read (binaryFile without its content column)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(root).select("path"))
    files = files.where(F.col("path").rlike(BID_PATH))
    return files.select(F.regexp_extract("path", BID_PATH, 1).alias("client"),
                        F.regexp_extract("path", BID_PATH, 2).alias("date")).distinct()


# ------------------------------------------------------------------ S5

def read_bid_changes(spark: SparkSession, root: str, client: str = "*",
                     date: str = "*", extra: tuple[str, ...] = ()) -> DataFrame:
    """(client, date, product_id, prediction, file_path, others, *extra) of all
    readable parts; a NaN prediction is NULL.

    Columns bind by the names in a file's first line, not by position; one that a part lacks is
    NULL there (a union by name). Columns beyond the two lie in the map ``others``; those named in ``extra`` also come out
    as columns. A file that is not readable as a whole gives no rows.
    """
    from .named_files import read_parts
    parts = read_parts(spark, root, client, date)
    return parts.select("client", F.col("date").try_cast("date").alias("date"), "product_id", "prediction", "file_path", "others",
                        *[F.try_element_at("others", F.lit(c)).alias(c) for c in extra])


def write_bid_part(bids: DataFrame, root: str, part: str, columns: tuple[str, ...] = ("product_id", "prediction")) -> None:
    """The rows (client, date, *columns) as the CSV file ``part`` of each <client>/<date> folder under ``root``."""
    from .named_files import write_lines
    name = F.concat_ws("/", "client", F.date_format("date", "yyyy-MM-dd"), F.lit(part))
    rows = bids.select(name.alias("name"), F.lit(1).alias("at"), F.to_csv(F.struct(*columns)).alias("line"))
    heads = rows.select("name").distinct().select("name", F.lit(0).alias("at"), F.lit(",".join(columns)).alias("line"))
    write_lines(rows.unionByName(heads), root)


# ------------------------------------------------------------------ S10

def read_site_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITE_CONFIG_SCHEMA).option("multiLine", True).json(path)


# ------------------------------------------------------------------ S12

def normalize_columns(df: DataFrame) -> DataFrame:
    """Header names lower-cased, spaces to underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): narratives of a complaints CSV (quoted, multi-line); an empty one is none.

    ``doc_id`` is the file's complaint id; a file without one gets row ids that hold for one read only.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').csv(path))
    df = normalize_columns(raw)
    own = F.col("complaint_id").cast("long") if "complaint_id" in df.columns else F.monotonically_increasing_id()
    return df.where(F.col("consumer_complaint_narrative").isNotNull()).select(
        own.alias("doc_id"), F.col("consumer_complaint_narrative").alias("text"))


# ------------------------------------------------------------------ S13

TASK_FILES = 1024    # files that a task reads, about


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, path, text): one row per file of the glob, the whole file decoded by the charset cascade.

    ``doc_id`` numbers the files by path from 0, so it is the same on every read of the same files; only
    paths are numbered. Folders are listed and files are read in tasks: no path reaches the driver.
    """
    from ..functions.text import decode_bytes
    from ..operators.rownumber import number_rows
    from .named_files import list_files, read_contents
    numbered = number_rows(list_files(spark, pattern), [F.asc("path")], out="doc_id")
    tasks = max(spark.sparkContext.defaultParallelism, numbered.count() // TASK_FILES)
    found = read_contents(numbered.select("doc_id", "path").repartition(tasks, "path"))
    return found.select("doc_id", "path", decode_bytes("content").alias("text"))


def write_documents(docs: DataFrame, path: str) -> None:
    """(name, content): each row a file of its name in folder ``path``."""
    from .named_files import write_files
    write_files(docs.select("name", F.col("content").cast("binary").alias("piece")), path)


# ------------------------------------------------------------------ sinks

SHEET_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_timesheet(sheet: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: a CSV file with header for each ISO day of the start (or end), called timesheet_<day>.csv, times to the microsecond.

    The job commits all files or none. A day is one file, so one task writes it, line by line.
    """
    from ..plans.timesheet import day_label
    from .named_files import write_lines
    columns = [c for c, kind in sheet.dtypes]
    times = {c: F.date_format(F.col(f"`{c}`"), SHEET_TIME) for c, kind in sheet.dtypes if kind.startswith("timestamp")}
    line = F.to_csv(F.struct(*[times.get(c, F.col(f"`{c}`")).alias(c) for c in columns]))
    day = F.coalesce(day_label(F.coalesce(F.col("Start"), F.col("End"))), F.lit("none"))
    lines = sheet.select(F.concat(F.lit("timesheet_"), day, F.lit(".csv")).alias("name"), F.lit(1).alias("at"), line.alias("line"))
    heads = lines.select("name").distinct().select("name", F.lit(0).alias("at"), F.lit(",".join(columns)).alias("line"))
    write_lines(lines.unionByName(heads), path, mode)


def read_timesheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The sheets of all days back, without the day column; ``schema`` is the written frame's."""
    return (spark.read.schema(schema).option("header", True).option("timestampFormat", SHEET_TIME)
            .option("timestampNTZFormat", SHEET_TIME).csv(path).select(*[f"`{c}`" for c in schema.fieldNames()]))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2/K3/K5: parquet at any Hadoop path (local, hdfs://, s3a://)."""
    df.write.mode(mode).parquet(path)


VECTOR_BUCKETS = 16
BUCKET_ROWS = 1 << 18      # vectors of 64 doubles in 128 MB


def write_vectors(vectors: DataFrame, path: str, key: str = "id", buckets: int = VECTOR_BUCKETS) -> str:
    """K3: vectors as a table bucketed and sorted by id, its files in ``path``; the table's name. Look-ups by id then shuffle
    the ids alone. ``buckets`` should grow with the vectors (128 MB each, say)."""
    name = f"vectors_{uuid.uuid4().hex}"
    (vectors.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
     .format("parquet").saveAsTable(name))
    return name


# ------------------------------------------------------------------ S1, S8, S9

def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None
              ) -> DataFrame:
    """A relational table read in ``num_partitions`` parallel range
    queries on ``partition_column``; filters applied to the result are
    pushed into the database queries."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=properties or {})


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A metastore table (product_catalog, prediction_performance)."""
    return spark.table(name)
