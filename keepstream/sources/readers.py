"""Scans: tables, tasks, questions, records, caches and video files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstream.sources import schemas


def tasks(spark: SparkSession, path: str, schema: str = schemas.TASK) -> DataFrame:
    """A task file, one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def questions(spark: SparkSession, path: str, schema: str = schemas.QUESTION_CSV) -> DataFrame:
    """A question CSV with a header; quotes are doubled, texts may hold line ends."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def json_lines(spark: SparkSession, path: str, schema: str = schemas.RECORD) -> DataFrame:
    """Records, one JSON object a line; blank lines are passed over."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def shard_lines(spark: SparkSession, pattern: str, prefix: str, excluded: str | None = None, schema: str = schemas.RECORD, depth: int = 1) -> DataFrame:
    """The records of all files of a glob whose name starts with ``prefix`` and lacks ``excluded``, with a task.

    The name is that of the file, or with a ``depth`` of 2 of the folder it lies in.
    """
    df = spark.read.schema(schema).json(pattern).withColumn("_name", F.element_at(F.split(F.input_file_name(), "/"), -depth))
    keep = F.col("_name").startswith(prefix)
    if excluded:
        keep &= ~F.col("_name").contains(excluded)
    return df.filter(keep & F.col("task").isNotNull()).drop("_name")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(setting, value): the settings of a run, one JSON object, values as text."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("setting", "value"))


def external_losses(spark: SparkSession, path: str) -> DataFrame:
    """(video_path, target_frames, losses) of a file of losses of another program, an object per video."""
    return spark.read.schema(schemas.PARITY).json(path).select("video_path", F.inline("windows")).withColumnRenamed("patch_loss_16x16", "losses")


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def bench_samples(df: DataFrame, order: str, most: int | None, base: str) -> DataFrame:
    """Samples with their video path, the first ``most`` by order if asked for: the limit is the feature."""
    out = df if most is None else df.orderBy(order).limit(most)
    return out.withColumn("video_path", F.concat(F.lit(base.rstrip("/") + "/"), F.col("video")))


def listed(spark: SparkSession, folder: str, glob: str = "*.mp4") -> DataFrame:
    """Path, length and time of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


#: A plug-in: a file's bytes and the wanted frame numbers give one array of values per frame.
Decoder = Callable[[bytes, list[int]], list[list[float]]]


def text_frames(content: bytes, wanted: list[int]) -> list[list[float]]:
    """A decoder of plain files: a line per frame, numbers between blanks."""
    lines = content.decode().splitlines()
    return [[float(x) for x in lines[i].split()] for i in wanted]


def decode(spark: SparkSession, folder: str, plan: DataFrame, decoder: Decoder, glob: str = "*") -> DataFrame:
    """(path, frame_idx, source_index, value): the planned frames of the files of a folder.

    ``plan`` has path, frame_idx and source_index. A file is read once and only the
    planned frames leave the decoder, so a clip or a budget never decodes the rest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")
    wanted = plan.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "source_index"))).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, frames in zip(*(b.column(c).to_pylist() for c in ("path", "content", "frames"))):
                values = decoder(content, [f["source_index"] for f in frames])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(frames)),
                        pa.array([f["frame_idx"] for f in frames], pa.int32()),
                        pa.array([f["source_index"] for f in frames], pa.int64()),
                        pa.array(values, pa.list_(pa.float64())),
                    ],
                    names=["path", "frame_idx", "source_index", "value"],
                )

    return files.join(wanted, "path").mapInArrow(run, "path string, frame_idx int, source_index bigint, value array<double>")
