"""Pipeline configurations as data: a frozen dataclass, a table of what ablations change, and a configs table."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Config:
    """None turns a stage off."""

    lexical_top_k: int | None = 20
    k1: float = 1.2
    b: float = 0.75
    semantic_top_k: int | None = 20
    rrf_k: int | None = 60
    gate_threshold: float | None = 0.42
    gate_signal: str = "dense_top1"
    rerank: str | None = "gray"
    gray_ratio: float = 1.6
    margin_ratio: float = 0.15
    shortlist: int = 10
    neighbours: int | None = 1
    width: int = 3
    rewrite: bool = True
    discriminator_guard: bool = True

    def __post_init__(self) -> None:
        if self.lexical_top_k is None and self.semantic_top_k is None:
            raise ValueError("one retrieval leg is needed")

    def hash(self) -> str:
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Change:
    """What an ablation sets, and the setting that must be on for it to mean anything."""

    settings: tuple[tuple[str, object], ...] = ()
    needs: str | None = None


#: The names of the ablations and what each one changes.
CHANGES = (
    ("baseline", Change()),
    ("no_lexical", Change((("lexical_top_k", None),))),
    ("no_semantic", Change((("semantic_top_k", None),))),
    ("no_fusion", Change((("rrf_k", None),))),
    ("no_gate", Change((("gate_threshold", None),))),
    ("no_rerank", Change((("rerank", None),))),
    ("force_rerank", Change((("rerank", "always"),), needs="rerank")),
    ("no_expansion", Change((("neighbours", None),))),
    ("top_k_1", Change((("width", 1),))),
    ("no_rewrite", Change((("rewrite", False),))),
    ("gate_on_fused", Change((("gate_signal", "fused_top1"), ("gate_threshold", 0.025)), needs="gate_threshold")),
    ("no_discriminator_guard", Change((("discriminator_guard", False),))),
)
ABLATIONS = dict(CHANGES)
COMPOSITES = ["no_lexical+no_discriminator_guard", "no_lexical+no_gate", "no_gate+no_discriminator_guard"]


def normalise(name: str) -> str:
    """Parts sorted and distinct, without baseline; baseline alone stays."""
    parts = sorted({p for p in name.split("+") if p and p != "baseline"})
    return "+".join(parts) or "baseline"


def compose(name: str, config: Config | None = None) -> Config:
    """The configuration after the changes of all parts of a name, in their order."""
    config = config or Config()
    if unknown := set(name.split("+")) - ABLATIONS.keys():
        raise KeyError(f"unknown ablation {', '.join(sorted(unknown))}")
    for part in name.split("+"):
        change = ABLATIONS[part]
        if change.needs and getattr(config, change.needs) is None:
            raise ValueError(f"{part} needs {change.needs}")
        config = replace(config, **dict(change.settings))
    return config


def plan(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """(names that give a configuration, the error of each other name by its normal form): what a sweep runs, and what it reports
    as failed instead of leaving out."""
    errors = {}
    for name in names:
        try:
            compose(name)
        except ValueError as error:
            errors[normalise(name)] = str(error)
    return [n for n in names if normalise(n) not in errors], errors


def configs(spark: SparkSession, names: list[str]) -> DataFrame:
    """config_id and a column for each setting, one row for each ablation name."""
    kinds = "config_id string, lexical_top_k int, k1 double, b double, semantic_top_k int, rrf_k int, gate_threshold double, gate_signal string, rerank string, gray_ratio double, margin_ratio double, shortlist int, neighbours int, width int, rewrite boolean, discriminator_guard boolean"
    return spark.createDataFrame([(normalise(n), *asdict(compose(n)).values()) for n in names], kinds)
