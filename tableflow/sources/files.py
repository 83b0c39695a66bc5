"""Delimited files, read once or as a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableflow.functions import names
from tableflow.operators.contract import Fields, apply_schema, field_types
from tableflow.operators.shape import positional_names


def _options(delimiter: str, header: bool, multiline: bool, encoding: str) -> dict[str, object]:
    return {
        "sep": delimiter,
        "header": header,
        "multiLine": multiline,
        "encoding": encoding,
        "quote": '"',
        "escape": '"',
        # Every file's header is compared with the schema instead of being skipped unread.
        "enforceSchema": not header,
    }


def _text_schema(fields: Fields) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in field_types(fields)])


def as_text(df: DataFrame) -> DataFrame:
    """All values as text, an empty cell as the empty text."""
    return df.select(*[F.coalesce(names.col(c), F.lit("")).alias(c) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    header: bool = True,
    fields: Fields | None = None,
    text: bool = False,
    multiline: bool = False,
    glob: str | None = None,
    recursive: bool = False,
    encoding: str = "UTF-8",
    broken: str | None = None,
) -> DataFrame:
    """Read delimited text; the header row names the columns.

    With ``fields`` the columns are the declared ones, found by name, in their declared types, NULL
    where a value does not convert. ``text=True`` keeps all values as text and an empty cell as "".
    Without a header the names come from ``fields`` by position, or are ``col0 .. colN``. Types are
    never inferred, so planning reads one line at most. ``multiline`` allows line breaks within
    quotes, at the price of one task per file. ``broken`` names a column for the text of records that do
    not parse (NULL for the others); the other columns are then text as read.
    """
    reader = spark.read.options(**_options(delimiter, header, multiline, encoding))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if not header and fields is not None:
        reader = reader.schema(_text_schema(fields))
    raw = reader.csv(path)
    if broken is not None:
        found = positional_names(raw) if not header and fields is None else raw
        wanted = T.StructType([*(T.StructField(c, T.StringType()) for c in found.columns), T.StructField(broken, T.StringType())])
        return reader.schema(wanted).option("columnNameOfCorruptRecord", broken).csv(path)
    if not header and fields is None:
        raw = positional_names(raw)
    if text:
        raw = as_text(raw)
        return raw if fields is None else raw.select(*[names.col(f) for f in field_types(fields)])
    return raw if fields is None else apply_schema(raw, fields)


def read_folder(spark: SparkSession, directory: str, file_name: str = "*.csv", **options) -> DataFrame:
    """A drop folder on any Hadoop file system: the files whose name matches the pattern."""
    return read_csv(spark, directory, glob=file_name, **options)


def stream_csv(
    spark: SparkSession,
    directory: str,
    fields: Fields,
    delimiter: str = ",",
    header: bool = True,
    text: bool = False,
    glob: str | None = None,
    max_files_per_batch: int | None = None,
    file_column: str | None = None,
    encoding: str = "UTF-8",
    multiline: bool = False,
    file_time_column: str | None = None,
) -> DataFrame:
    """A stream of the files arriving in a folder; files stay, the checkpoint takes each once.

    The declared fields must be in header order: a stream's schema is fixed before its first file.
    ``file_column`` adds the path of each row's file, and ``file_time_column`` when that was last changed, as text that sorts by time.
    """
    if not fields:
        raise ValueError("a stream of files needs inputSchema.fields: its columns are fixed before the first file arrives")
    reader = spark.readStream.options(**_options(delimiter, header, multiline, encoding))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    raw = reader.schema(_text_schema(fields)).csv(directory)
    wanted = field_types(fields)
    changed = F.format_string("%020d", F.unix_micros("_metadata.file_modification_time"))
    told = {file_column: F.col("_metadata.file_path"), file_time_column: changed}
    told = {name: value for name, value in told.items() if name}
    if told:
        raw = raw.select("*", *[value.alias(name) for name, value in told.items()])
        wanted |= dict.fromkeys(told, "STRING")
    return as_text(raw) if text else apply_schema(raw, wanted)


def read_raw(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Each file's whole content as one ``_value``."""
    # DataFrameReader.text would override the option with its own argument's default.
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).withColumnRenamed("value", "_value")
