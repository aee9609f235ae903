"""File sources and sinks: landed documents, JSON lines, line protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barlake.operators.decode import parse_once
from barlake.schemas import BAR, BAR_DOCUMENT


MALFORMED = "malformed"

# JSON lines are compressed by these settings of Hadoop's codec: bars get as small as by its defaults, in two
# thirds of their time. Such files cannot be split, so their lines bound what a task reads (60 MB of text for bars).
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR", "zlib.compress.strategy": "FILTERED"}
LINES_PER_FILE = 250_000


def _name_in_path() -> Column:
    """File name without its ending; names are percent-encoded in paths."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def read_bar_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Landed bar responses, one document per file named after its ticker.

    The reader parses each document once.
    """
    documents = spark.read.schema(BAR_DOCUMENT).option("multiLine", "true").json(folder)
    return documents.select(_name_in_path().alias("symbol"), "*")


def checked(texts: DataFrame, schema: StructType, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """JSON texts (`value`) to (rows, rejected). A text that is no JSON object, which would otherwise
    become a row of nulls, is rejected as it is (`malformed`); blank ones are no records. Texts are parsed
    once for both; `keep` are columns to carry along."""
    whole = StructType([*schema.fields, StructField(MALFORMED, StringType())])
    record = F.from_json("value", whole, {"columnNameOfCorruptRecord": MALFORMED})
    kept = texts.filter(F.trim("value") != "").select(*keep, "value")
    names = kept.columns[:-1]
    rows = parse_once(kept, record, "record")
    broken = F.col("record").isNull() | F.col(f"record.{MALFORMED}").isNotNull()
    return (rows.filter(~broken).select(*names, *[F.col(f"record.{name}") for name in schema.names]),
            rows.filter(broken).select(*names, F.col("value").alias(MALFORMED)))


def read_bar_documents_checked(spark: SparkSession, folder: str, key: str | None = None,
                               ) -> tuple[DataFrame, DataFrame]:
    """Landed bar responses and the files that are no JSON. The ticker is the file's name, or that of a
    folder named after `key`."""
    files = spark.read.text(folder, wholetext=True)
    symbol = _name_in_path() if key is None else F.col(key).cast("string")
    return checked(files, StructType.fromDDL(BAR_DOCUMENT), symbol.alias("symbol"))


def read_bars_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bronze bars from JSON lines, and the lines that are no JSON with the name of their file."""
    rows, broken = checked(spark.read.text(path), BAR, F.col("_metadata.file_name").alias("file"))
    return rows.drop("file"), broken


def read_documents(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Landed responses, one per file, as (key, seq, value).

    The key is the file's name, or the value of a folder named after it (`ticker=GC%3DF/...`). Later files
    have a larger seq, by modification time. Texts are kept whole.
    """
    files = spark.read.text(folder, wholetext=True)
    return files.select(
        (F.col(key).cast("string") if key in files.columns else _name_in_path()).alias(key),
        F.unix_micros("_metadata.file_modification_time").alias("seq"), "value")


def write_documents(documents: DataFrame, folder: str, key: str) -> None:
    """Responses (key, value) as text files in one folder per key; a key has one document."""
    documents.select(key, "value").write.partitionBy(key).text(folder)


def read_bars(spark: SparkSession, path: str, schema: StructType | None = BAR) -> DataFrame:
    """Bronze bars from JSON lines; without a schema Spark infers one from the data.

    Inference reads everything once more and leaves dates as text, so state the schema at scale.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_bar_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Distinct symbols of bars that `write_json_lines` has written, in which the symbol comes first.

    A line is cut at its first `,"`, which no text can hold, as quotes in texts are escaped. So lines are not
    parsed, only their distinct beginnings are. (Without `parse_once` a caller's own distinct would replace
    this one, and every line would be parsed.)
    """
    begins = spark.read.text(path).select(F.substring_index("value", ',"', 1).alias("begin")).distinct()
    bar = F.from_json(F.concat("begin", F.lit("}")), StructType([BAR["symbol"]]))
    return parse_once(begins, bar, "bar").select("bar.symbol")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replace the folder with one JSON object per row; null fields are written out.

    Every line repeats the names of the fields, so files are compressed; readers see that by their names.
    """
    (df.write.mode("overwrite").options(ignoreNullFields="false", maxRecordsPerFile=LINES_PER_FILE, **GZIP)
     .json(path))


def write_lines(lines: DataFrame, path: str) -> None:
    """Append one-column text rows, such as line protocol."""
    lines.write.mode("append").text(path)
