"""Written results: packet tables, feature rows, verdicts and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.sources.captures import file_system


def write_packets(packets: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Land packets as Parquet by day, so that later reads prune days and columns."""
    by_day = packets.withColumn("day", F.to_date(F.timestamp_micros("ts_us")) if "ts_us" in packets.columns
                                else F.to_date("timestamp"))
    by_day.write.mode(mode).partitionBy("day").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header line; times as epoch seconds, maps as JSON text."""
    flat = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("map", "struct", "array"):
            flat.append(F.to_json(F.col(f.name)).alias(f.name))
        elif kind == "timestamp":
            flat.append((F.unix_micros(f.name) / F.lit(1e6)).cast("decimal(20,6)").alias(f.name))
        else:
            flat.append(F.col(f.name))
    df.select(*flat).write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """JSON lines; NULL fields are written too, so every line has all fields."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_captures(parts: DataFrame, folder: str) -> str:
    """Files from their parts (path below the folder, part, content), joined in the order of the parts.

    A file is written by one task, part after part, under another name and gets its own when it is complete.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        name, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                system.move(f"{inner}/{name}.part", f"{inner}/{name}")

        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                if path != name:
                    close()
                    name = path
                    system.create_dir(f"{inner}/{path}".rpartition("/")[0])
                    out = system.open_output_stream(f"{inner}/{path}.part")
                out.write(content.as_buffer())
            yield batch.select(["path"])
        close()

    dealt = parts.select("path", "part", "content").repartition("path").sortWithinPartitions("path", "part")
    dealt.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return folder
