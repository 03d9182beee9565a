"""Sinks: records, merged shards, reports, the score cache and traces."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_records(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Records as JSON lines; ``fresh`` starts anew, else a run goes on where it ended."""
    df.write.mode("overwrite" if fresh else "append").json(path, ignoreNullFields=False)


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def merged(parts: list[DataFrame]) -> DataFrame:
    """The outputs of shards as one, by column name; columns some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_arrays(df: DataFrame, path: str, most: int = 10_000) -> None:
    """Files that hold a JSON array each, of at most ``most`` rows: a task list in parts that are read side by side."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            for j in b.column(0).to_pylist():
                held.append(j)
                if len(held) == most:
                    yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])

    # one array a file
    df.select(F.to_json(F.struct(*df.columns)).alias("j")).mapInArrow(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def put_scores(cache: DataFrame | None, new: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The score cache after an upsert: entries of ``new`` replace those of the same key.

    Written beside the old files and read back from there, so a reader never sees a
    half-written cache.
    """
    out = new if cache is None else cache.join(new.select(*keys), keys, "left_anti").unionByName(new)
    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    out.write.parquet(target)
    return new.sparkSession.read.parquet(target)


def write_report(spark: SparkSession, summary: DataFrame, path: str, title: str, most: int = 1000) -> tuple[str, str]:
    """A summary as JSON and as a Markdown table; returns both texts.

    For aggregates of a few rows: more than ``most`` rows are an error, not a cut.
    """
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cells = [r.asDict(recursive=True) for r in rows]
    text = json.dumps(cells, indent=2, default=str, ensure_ascii=False)
    head = "| " + " | ".join(summary.columns) + " |\n|" + " --- |" * len(summary.columns)
    shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    table = "\n".join([f"# {title}", "", head, *("| " + " | ".join(shown(c[k]) for k in summary.columns) + " |" for c in cells)])
    out = spark.createDataFrame([("json", text), ("markdown", table)], "kind string, value string")
    out.coalesce(1).write.mode("overwrite").partitionBy("kind").text(path)
    return text, table


def append_trace(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_config(spark: SparkSession, settings: dict, path: str) -> None:
    """The settings of a run as one JSON object."""
    row = spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)
