"""Markdown reports from small aggregates, and guards on what may be compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a run's provenance that must agree before two runs are compared.
COMPARED = ("corpus", "code", "provider", "embed", "rerank", "generate")
#: Of those, parts that a run can lack: one that has none compares with any.
OPTIONAL = ("embed", "rerank")
MOST_ROWS = 1000


def table(df: DataFrame, title: str) -> str:
    """A Markdown table of an aggregate; more than MOST_ROWS rows are an error, not cut off."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{title}: a report is for small aggregates")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def comparable(a: str, b: str) -> Column:
    """The join predicate of runs that may be compared: their provenance, struct columns a and b, agrees."""
    agree = [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in COMPARED if k not in OPTIONAL]
    agree += [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) | F.coalesce(F.col(f"{a}.{k}") == "none", F.lit(False)) | F.coalesce(F.col(f"{b}.{k}") == "none", F.lit(False)) for k in OPTIONAL]
    return reduce(Column.__and__, agree)


def assert_comparable(a: dict[str, str], b: dict[str, str]) -> None:
    """The same for two runs on the driver: an error that names all parts in which they differ."""
    lacking = {k for k in OPTIONAL if "none" in (a.get(k), b.get(k))}
    apart = {k for k, _ in {(k, a.get(k)) for k in COMPARED} ^ {(k, b.get(k)) for k in COMPARED}} - lacking
    if apart:
        raise ValueError(f"runs differ in {', '.join(sorted(apart))}")


def exit_code(new_failures: int, new_blocking: int) -> int:
    return int(bool(new_failures or new_blocking))
