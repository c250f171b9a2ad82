"""Readers: driver tables, reference lists, uploaded files, pasted text; and the JSON sink."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest mail and file, and the endings of files that are read.
MAX_MAIL, MAX_FILE = 5 << 20, 10 << 20
FILE_SUFFIXES = tuple(".png .jpg .jpeg .webp .bmp .gif .tiff .pdf .docx .xlsx .pptx .doc .xls .ppt .txt .html .htm .csv .eml .ics".split())

INDICATORS = "row_id long, raw string"
HEADERS = "msg_id long, pos int, name string, value string"
CALLS = "ts timestamp, session_id string, api string, method string, violation boolean"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores, evenly or by keys: for narrow rows with dear work to follow, of which a file of few bytes makes a single task.

    The number of tasks is given, as adaptive execution would bring so few bytes together again.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table, file or folder, as a stream of its files."""
    # a pattern, as a plain path of a stream must be a folder
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables below the one that ``spark.checkpoint.dir`` or the session names.

    Only a session in a single process gets one in the machine's own temporary folder.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", "") or (held.get() if held.isDefined() else "")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def listed(value: Column, key: str | None = None) -> Column:
    """Items of a JSON array of strings, or of one under a key: lower case, trimmed, the first of equals; none of anything else."""
    items = F.from_json(value, "array<string>" if key is None else f"struct<{key}:array<string>>")
    items = items if key is None else items[key]
    clean = F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    return F.coalesce(clean, F.array().cast("array<string>"))


def json_list(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(ord, item) of the items ``listed`` in a file; one that holds no list gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(listed(F.col("value"), key)).alias("ord", "item"))


def list_values(spark: SparkSession, path: str, key: str | None = None, most: int = 100_000) -> tuple[str, ...]:
    """A reference list as a tuple, in order, for functions that take one; at most ``most`` entries."""
    try:
        rows = json_list(spark, path, key).orderBy("ord").limit(most + 1).collect()
    except Exception as error:  # an unreadable list counts as empty
        if "PATH_NOT_FOUND" in str(error):
            return ()
        raise
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} entries: join it instead")
    return tuple(r["item"] for r in rows)


def mail_files(spark: SparkSession, folder: str, max_bytes: int = MAX_MAIL) -> DataFrame:
    """(path, raw) of the .eml files of a folder; the size is tested before a file is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.col("length") <= max_bytes).select("path", F.col("content").alias("raw"))


def uploaded_files(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """(filename, content_type, payload) of the files of a folder with a known ending."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    found = found.where(suffix.isin(*FILE_SUFFIXES) & (F.col("length") <= max_bytes))
    return found.select(F.substring_index("path", "/", -1).alias("filename"), F.lit("").alias("content_type"), F.col("content").alias("payload"))


def pasted(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """(pos, raw) and the columns to keep: a pasted list's lines, trimmed, those of a known type only."""
    from ..functions.text import client_input_type

    lines = df.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "raw")).select(*keep, "pos", F.trim("raw").alias("raw"))
    return lines.where(client_input_type(F.col("raw")) != "unknown")


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for any text or message sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, its lineage cut: for tables that a plan reads many times."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
