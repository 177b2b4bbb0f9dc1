"""Where a run's numbers come from: stages that a configuration has, version stamps, and guards on what may be compared."""

from __future__ import annotations

import hashlib
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import report
from .config import Config

#: The stages in their order, each with the setting that turns it off (None: always on).
STAGES = (
    ("rewrite", "rewrite"), ("embed", "semantic_top_k"), ("retrieve_dense", "semantic_top_k"), ("retrieve_sparse", "lexical_top_k"), ("fuse", "rrf_k"),
    ("gate", "gate_threshold"), ("rerank", "rerank"), ("expand", "neighbours"), ("generate", None),
)


def stage_enabled(config: Config, stage: str) -> bool:
    """Whether a configuration runs a stage; an unknown one raises KeyError."""
    setting = dict(STAGES)[stage]
    return setting is None or getattr(config, setting) not in (None, False)


def stage_grid(configs: DataFrame) -> DataFrame:
    """config_id, seq, stage, enabled of a table of configurations."""
    on = [F.struct(F.lit(i).alias("seq"), F.lit(s).alias("stage"), (F.lit(True) if c is None else F.coalesce(F.col(c).cast("string") != "false", F.lit(False))).alias("enabled")) for i, (s, c) in enumerate(STAGES)]
    return configs.select("config_id", F.explode(F.array(*on)).alias("s")).select("config_id", "s.*")


@cache
def code_version() -> str:
    """src@ and 8 hex digits over this package's sources."""
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for file in sorted(root.rglob("*.py")):
        digest.update(file.relative_to(root).as_posix().encode() + b"\0" + file.read_bytes())
    return "src@" + digest.hexdigest()[:8]


def versions(config: Config, corpus: str, embed: str = "concept", provider: str = "offline", rerank: str = "coverage", generate: str = "extractive", simulated: tuple[str, ...] = ("embed", "rerank", "generate")) -> dict[str, str]:
    """The stamp of a run: what is simulated carries sim:, what the configuration turns off is none."""
    named = {"embed": embed if stage_enabled(config, "embed") else None, "rerank": rerank if stage_enabled(config, "rerank") else None, "generate": generate}
    parts = {k: "none" if v is None else f"sim:{v}" if k in simulated else v for k, v in named.items()}
    return {"corpus": corpus, "code": code_version(), "provider": provider} | parts


def stamped(df: DataFrame, stamp: dict[str, str]) -> DataFrame:
    """df with a struct column versions, for a report or a trace."""
    return df.withColumn("versions", F.struct(*[F.lit(stamp[k]).alias(k) for k in report.COMPARED]))


def assert_deterministic(temperature: float) -> None:
    """Runs that are to be compared draw nothing at random."""
    if temperature != 0:
        raise ValueError(f"temperature is {temperature}; runs that are compared need 0")
