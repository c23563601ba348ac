"""Where models plug in: Arrow batches in, one model load a worker, arithmetic left to Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_scorer(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function text -> array<float> from an embedding model; blank texts have no vector."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            kept = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list = [None] * len(texts)
            if kept:
                for i, v in zip(kept, np.asarray(model([texts.iloc[i] for i in kept]), np.float32)):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return embed


def prompt_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], prompts: list[str]):
    """A column function path -> array<double>, one score a prompt."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for paths in batches:
            yield pd.Series(list(np.asarray(model(paths.tolist(), prompts), float)))

    return score


def transcriber(df: DataFrame, load: Callable[[], Callable[[bytes], str]], content: str = "content", out: str = "text") -> DataFrame:
    """Rows with a binary column to rows with its text (speech or on-screen text); the column is dropped."""
    kept = [c for c in df.columns if c != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content) + f", `{out}` string"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pdf[kept].assign(**{out: [model(x) for x in pdf[content]]})

    return df.mapInPandas(task, schema)


def subprocess_answers(df: DataFrame, command: list[str], request: str = "request", out: str = "answer") -> DataFrame:
    """A JSON line out, a JSON line in, one process a partition."""
    import subprocess

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) as p:
            for pdf in batches:
                answers = []
                for line in pdf[request]:
                    p.stdin.write(line.replace("\n", " ") + "\n")
                    p.stdin.flush()
                    answers.append(p.stdout.readline().rstrip("\n"))
                yield pdf.assign(**{out: answers})
            p.stdin.close()

    return df.mapInPandas(task, schema)


def answerer(load: Callable[[], Callable[[str, list[str]], str]]):
    """Answer gateway: a column function (question, evidence texts) -> answer from a model loaded once a worker. Rows
    without a question or evidence have no answer."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, evidence in batches:
            yield pd.Series([model(q, list(e)) if q and e is not None and len(e) else None for q, e in zip(questions, evidence)], dtype=object)

    return answer


def echo(question: str, evidence: list[str]) -> str:
    """The gateway without a model: the evidence itself."""
    return " ".join(evidence)


#: A candidate extractor: ingested rows in, candidates (video_id, id, modality, t, text) out.
Extractor = Callable[[DataFrame], DataFrame]
CANDIDATE_COLUMNS = ["video_id", "id", "modality", "t", "text"]


def frame_candidates(frames: DataFrame) -> DataFrame:
    """Visual candidates of (video_id, frame_index, timestamp_seconds, ocr_text)."""
    text = F.when(F.btrim(F.coalesce("ocr_text", F.lit(""))) != "", F.concat(F.lit("On-screen text near "), F.format_string("%.0f", "timestamp_seconds"), F.lit(" seconds: "), F.col("ocr_text")))
    placeholder = F.concat(F.lit("Visual frame sampled at "), F.format_string("%.2f", "timestamp_seconds"), F.lit(" seconds"))
    return frames.select("video_id", F.concat(F.lit("visual-"), F.col("frame_index").cast("string")).alias("id"), F.lit("visual").alias("modality"), F.col("timestamp_seconds").alias("t"), F.coalesce(text, placeholder).alias("text"))


def window_candidates(windows: DataFrame) -> DataFrame:
    """Audio candidates of (video_id, window_index, start_seconds, end_seconds, transcript_text)."""
    return windows.select("video_id", F.concat(F.lit("audio-"), F.col("window_index").cast("string")).alias("id"), F.lit("audio").alias("modality"), ((F.col("start_seconds") + F.col("end_seconds")) / 2).alias("t"), F.coalesce("transcript_text", F.lit("")).alias("text"))


def extract(sources: list[tuple[DataFrame, Extractor]]) -> DataFrame:
    """All extractors' candidates as one table."""
    out = None
    for rows, extractor in sources:
        part = extractor(rows).select(*CANDIDATE_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def semantic_scores(candidates: DataFrame, vector: str = "vector", query_vector: str = "query_vector") -> DataFrame:
    """Semantic text scorer: cosine of each candidate's text vector and its question's, written back to saliency; blank
    texts (no vector) score 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    a, b = F.col(vector), F.col(query_vector)
    cosine = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return candidates.withColumn("saliency", F.when(F.btrim(F.coalesce("text", F.lit(""))) == "", 0.0).otherwise(F.greatest(F.lit(0.0), cosine))).drop(vector)


def screen_reader(load: Callable[[], Callable[[bytes], str]], crop: Callable[[bytes], bytes], content: str = "content", out: str = "text"):
    """A step for ``cache.cached``: text on screen, and where a frame gives none, that of its crop."""

    def compute(df: DataFrame) -> DataFrame:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                yield pdf[["key"]].assign(**{out: [(model(bytes(x)) or "").strip() or (model(crop(bytes(x))) or "").strip() for x in pdf[content]]})

        return df.mapInPandas(task, f"key string, {out} string")

    return compute
