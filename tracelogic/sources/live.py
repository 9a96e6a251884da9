"""Live sources and sinks: lines from a socket, a directory or a message queue, and verdict lines to where they go."""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def read_lines(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A stream of lines (column value).

    socket: host, port. directory: path (new files are read as they come). queue: servers, topic; needs Spark's Kafka
    connector on the class path, else Spark says that the source is missing.
    """
    if kind == "socket":
        return spark.readStream.format("socket").option("host", options["host"]).option("port", options["port"]).load()
    if kind == "directory":
        files = spark.readStream.option("maxFilesPerTrigger", options.get("files", "100"))
        return files.text(options["path"])
    if kind == "queue":
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", options["servers"]).option("subscribe", options["topic"]).option("startingOffsets", options.get("from", "earliest")).load()
        return raw.select(F.explode(F.split(F.col("value").cast("string"), "\n")).alias("value"))
    raise ValueError(f"unknown source {kind}")


def send(rows, host: str, port: int) -> None:
    """Lines to a socket; a partition opens one connection."""
    with socket.create_connection((host, port)) as s:
        for r in rows:
            s.sendall((r["line"] + "\n").encode())


def write_lines(lines: DataFrame, kind: str, checkpoint: str, **options: str) -> DataStreamWriter:
    """A writer of the stream's ``line`` column to a directory, the console, a socket or a message queue."""
    out = lines.select("line")
    if kind == "directory":
        writer = out.writeStream.format("text").option("path", options["path"])
    elif kind == "console":
        writer = out.writeStream.format("console").option("truncate", "false")
    elif kind == "socket":
        host, port = options["host"], int(options["port"])
        writer = out.writeStream.foreachBatch(lambda df, _: df.foreachPartition(lambda rows: send(rows, host, port)))
    elif kind == "queue":
        writer = out.select(F.col("line").alias("value")).writeStream.format("kafka").option("kafka.bootstrap.servers", options["servers"]).option("topic", options["topic"])
    else:
        raise ValueError(f"unknown sink {kind}")
    return writer.option("checkpointLocation", checkpoint)


def late_rows(events: DataFrame, delay: int) -> DataFrame:
    """For a batch of events (source, emission, ts, ...): late, whether a row came after a promise that it broke.

    After emission e of a source nothing older than the source's largest ts before, less ``delay`` seconds, is
    expected; rows that are older are late and would be dropped by a watermark.
    """
    from pyspark.sql.window import Window

    before = Window.partitionBy("source").orderBy("emission").rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_top", F.max("ts").over(before)).withColumn("late", F.coalesce(F.col("ts") < F.col("_top") - delay, F.lit(False))).drop("_top")
