"""A session with the settings that results depend on, and options of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .functions import vocab


@dataclass(frozen=True)
class Options:
    """Settings of retrieval and dedup; each is validated when it is made."""

    top_k: int = vocab.TOP_K
    min_score: float = vocab.MIN_SCORE
    similarity_threshold: float = vocab.SIMILARITY_THRESHOLD
    max_chunk: int = vocab.MAX_CHUNK
    overlap: int = vocab.OVERLAP

    def __post_init__(self):
        if self.top_k < 1 or not 0 <= self.min_score <= 1 or not 0 < self.similarity_threshold <= 1 or self.max_chunk < 1 or not 0 <= self.overlap < self.max_chunk:
            raise ValueError(f"not usable: {self}")


def session(app: str = "veldrin", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
