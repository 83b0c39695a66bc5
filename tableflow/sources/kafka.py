"""Kafka topics: reader options and decoding of the raw value.

Reading a topic needs the Kafka connector package on the class path; the decoding works on any
DataFrame with a ``value`` column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableflow.functions import casts, names
from tableflow.operators.contract import Fields, field_types

# Fixed value: consumer group where none is given.
DEFAULT_GROUP = "etl-group"


def kafka_options(connection: Mapping[str, str]) -> dict[str, str]:
    """Spark's reader options of a ``{bootstrapServers, topic, groupId}`` connection.

    Progress lives in the stream's checkpoint, not in the group; the group only prefixes the ids
    of the consumers Spark starts.
    """
    return {
        "kafka.bootstrap.servers": connection["bootstrapServers"],
        "subscribe": connection["topic"],
        "groupIdPrefix": connection.get("groupId") or DEFAULT_GROUP,
    }


def stream_topic(spark: SparkSession, connection: Mapping[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(connection)).load()


def raw_value(df: DataFrame, value: str = "value") -> DataFrame:
    """The undecoded message as ``_value``."""
    return df.select(names.col(value).cast("string").alias("_value"))


def _decoded(df: DataFrame, fields: Fields, message: Column, keep: tuple[str, ...]) -> DataFrame:
    kept = [names.col(c) for c in keep]
    parsed = df.select(*kept, message.alias("__message"))
    typed = [
        casts.try_value(F.col("__message")[name], T.StringType(), target).alias(name)
        for name, target in field_types(fields).items()
    ]
    return parsed.select(*kept, *typed)


def _text_shape(fields: Fields) -> str:
    return ", ".join(f"`{n}` string" for n in field_types(fields))


def decode_json(df: DataFrame, fields: Fields, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One column per declared field of a JSON message; a broken message or value gives NULL.

    ``keep`` names columns of ``df``, such as key or timestamp, to put in front.
    """
    return _decoded(df, fields, F.from_json(names.col(value).cast("string"), _text_shape(fields)), keep)


def decode_csv(
    df: DataFrame, fields: Fields, value: str = "value", delimiter: str = ",", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One column per declared field of a delimited message, by position."""
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    message = F.from_csv(names.col(value).cast("string"), _text_shape(fields), options)
    return _decoded(df, fields, message, keep)
