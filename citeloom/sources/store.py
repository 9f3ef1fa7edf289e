"""The document store: uploads, documents with their history, proposals, cached answers, event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024


def read_uploads(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` files of a folder; rejected ones carry the status a client would get.

    The content of a rejected file is never read: name and length decide.
    """
    files = spark.read.format("binaryFile").load(path)
    status = F.when(~F.lower("path").endswith(".pdf"), "415").when(F.col("length") > most_bytes, "413").when(F.col("length") == 0, "400")
    rejected = files.select("path", "length", status.alias("status")).filter("status IS NOT NULL")
    good = F.lower("path").endswith(".pdf") & (F.col("length") <= most_bytes) & (F.col("length") > 0)
    return files.filter(good), rejected


def pdf_header(files: DataFrame) -> DataFrame:
    """``(path, is_pdf, year)`` of binary files: the signature, and the year of the creation date if one is found."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    year = F.nullif(F.regexp_extract(head, r"/CreationDate\s*\(D:(\d{4})", 1), F.lit("")).cast("int")
    return files.select("path", head.startswith("%PDF-").alias("is_pdf"), year.alias("year"))


def save_versions(df: DataFrame, path: str) -> None:
    """Append versions (paper_id, version_ts, document) to the store, one folder a day."""
    df.withColumn("day", F.date_format("version_ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def current_versions(versions: DataFrame, key: str = "paper_id", ts: str = "version_ts") -> DataFrame:
    """The last version of each document; of equal times any one."""
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return versions.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def load_document(versions: DataFrame, paper_id: str) -> DataFrame:
    """The current version of one document: an empty result if it is unknown."""
    return current_versions(versions.filter(F.col("paper_id") == paper_id))


def parse_events(text: DataFrame, column: str = "value") -> DataFrame:
    """``(stream, seq, event, payload)`` of server-sent frames; an unfinished last frame waits, so it gives no row.

    text: stream, value (all that arrived so far).
    """
    frames = F.split(F.col(column), "\n\n", -1)
    whole = F.slice(frames, F.lit(1), F.size(frames) - 1)
    body = F.regexp_replace("frame", r"(?m)^data: ?", "")
    rows = text.select("stream", F.posexplode(whole).alias("seq", "frame")).filter("frame LIKE 'data:%'")
    return rows.select("stream", "seq", F.get_json_object(body, "$.type").alias("event"), body.alias("payload"))
