"""Files in and out: JSON lines, artifacts, manifests, tagged logs, CSV."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import EXTRACTION_PRESETS

CANDIDATE = "id string, timestamp_seconds double, text string, saliency_score double, segment_id string, scene_start_seconds double, scene_end_seconds double, temporal_anchor_score double, temporal_target_score double"
EXAMPLE = f"id string, video_id string, query string, duration_seconds double, relevant_timestamps array<double>, timestamp_tolerance_seconds double, expected_answer string, choices array<string>, visual_candidates array<struct<{CANDIDATE}>>, audio_candidates array<struct<{CANDIDATE}>>"
MEASUREMENT = "record string, stage string, wall_seconds double, resident_gb double, peak_reserved_gb double, activation_gb double, oom boolean, error string, extra map<string, string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, line) of lines that are no JSON object, for error messages; files are read whole, one a row."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    bad = (F.trim("line") != "") & F.try_parse_json("line").isNull()
    return lines.filter(bad).select((F.col("pos") + 1).alias("line_number"), "line")


def candidates(examples: DataFrame) -> DataFrame:
    """Examples' nested candidates as rows of one table with a modality column."""
    def tagged(column: str, modality: str):
        return F.transform(F.coalesce(column, F.array().cast(examples.schema[column].dataType)), lambda x: F.struct(F.lit(modality).alias("modality"), x.alias("c")))

    both = F.concat(tagged("visual_candidates", "visual"), tagged("audio_candidates", "audio"))
    return examples.select("video_id", F.col("id").alias("query_id"), "query", F.explode(both).alias("x")).select("video_id", "query_id", "query", "x.modality", "x.c.*")


def resolve_files(examples: DataFrame, listing: DataFrame, extensions=(".mp4", ".mov", ".mkv", ".webm")) -> DataFrame:
    """Examples (video_id, video_path) with the file of that stem, by extension order; listing has a path column."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))
    files = listing.withColumn("rank", rank).filter("rank > 0").groupBy(F.regexp_replace(name, r"\.[^.]+$", "").alias("video_id")).agg(F.min_by("path", F.struct("rank", "path")).alias("found"))
    return examples.join(files, "video_id", "left").withColumn("video_path", F.coalesce("video_path", "found")).drop("found")


def read_artifacts(spark: SparkSession, root: str, schema: str, include: str | None = None, query_terms: list[str] = (), least: int = 0) -> DataFrame:
    """compression.json files below a root, wrapped in {compression: ...} or bare; filters by path, by all query words
    and by the number of selected items."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "compression.json").option("multiLine", "true").schema(f"compression struct<{schema}>, {schema}").json(root)
    raw = raw.withColumn("path", F.input_file_name())
    names = [c for c in raw.columns if c not in ("compression", "path")]
    out = raw.select("path", F.coalesce("compression", F.struct(*names)).alias("c")).select("path", "c.*")
    if include:
        out = out.filter(F.col("path").rlike(include))
    for t in query_terms:
        out = out.filter(F.contains(F.lower("query"), F.lit(t.lower())))
    return out.filter(F.size("selected") >= least)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a manifest under any of three names: one JSON object a line, or one JSON array over any number of lines."""
    schema = "compression_path string, path string, artifact string"
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).head()
    m = spark.read.schema(schema).option("multiLine", "true" if first and first[0].lstrip().startswith("[") else "false").json(path)
    return m.select(F.coalesce("compression_path", "path", "artifact").alias("path")).filter("path is not null")


def write_manifest(paths: DataFrame, path: str) -> None:
    """A manifest of JSON lines from a column ``path``."""
    paths.select(F.col("path").alias("compression_path")).write.mode("overwrite").json(path)


def read_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog of extraction schemas in a folder: name, description, item_type, labels, fields."""
    field = "struct<name: string, description: string, required: boolean>"
    return spark.read.option("multiLine", "true").option("pathGlobFilter", "*.schema.json").schema(f"name string, description string, item_type string, labels array<string>, fields array<{field}>").json(folder)


def resolve_schema(catalog: DataFrame, name: str | None = None, preset: str | None = None) -> DataFrame:
    """The one schema of a catalog with this name, or that a preset stands for; exactly one of both is given."""
    if (name is None) == (preset is None):
        raise ValueError("give exactly one of name and preset")
    if preset is not None:
        if preset.strip().lower().replace("_", "-") not in EXTRACTION_PRESETS:
            raise ValueError(f"unknown extraction preset {preset}; there are {', '.join(EXTRACTION_PRESETS)}")
        name = EXTRACTION_PRESETS[preset.strip().lower().replace("_", "-")][0]
    found = catalog.filter(F.col("name") == name.strip().lower().replace("-", "_"))
    if found.isEmpty():
        raise ValueError(f"unknown extraction schema {name}")
    return found


def markdown_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line): a small result as a Markdown table; write ``line`` with ``write.text``."""
    head = df.sparkSession.createDataFrame([(1, f"| {' | '.join(columns)} |"), (2, f"|{' --- |' * len(columns)}")], "line_no long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = df.select((F.row_number().over(W.orderBy(*order)) + 2).cast("long").alias("line_no"), line.alias("line"))
    return head.unionByName(rows)


def server_events(event: Column, data: Column) -> Column:
    """A server-sent event frame of a name and a struct."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


@contextmanager
def measured(stage: str, sink: list[dict]) -> Iterator[None]:
    """Stage measurement: wall time and peak memory of the driver process around a block, and its error if it fails, as
    one row of the measurement log (``spark.createDataFrame(sink)``, then ``append_jsonl``)."""
    began, row = time.perf_counter(), {"record": "stage", "stage": stage, "error": None}
    try:
        yield
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {e}"
        raise
    finally:
        sink.append(row | {"wall_seconds": time.perf_counter() - began, "resident_gb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6})


def read_measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(device rows, stage rows) of a tagged log."""
    rows = spark.read.schema(MEASUREMENT).json(path)
    return rows.filter("record = 'device'"), rows.filter("record = 'stage'")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_items_csv(items: DataFrame, path: str, fields: list[str]) -> None:
    """Extracted items with one column for each field of the schema's dimension."""
    flat = [c for c in items.columns if c != "values"]
    items.select(*flat, *[F.col("values")[f].alias(f) for f in fields]).write.mode("overwrite").option("header", "true").csv(path)


def replace_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that the rows belong to and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
