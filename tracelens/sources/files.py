"""Files: Markdown trees, written indexes, test sets, traps, labels, baselines, snapshots, traces."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import guard_duplicates

TESTSET = "case_id string, tenant_id string, kind string, query string, answer_key string, history array<string>"
LABELS = "query string, baseline string, variant string, label string"
TRAP_KEYS = ("id", "failure_class", "tenant", "query", "expected_behaviour", "reason")
TRAPS = "id string, failure_class string, tenant string, query string, expected_behaviour string, reason string, no_confident_claim boolean, must_contain_any array<string>, must_not_contain array<string>, acceptable_refusal_markers array<string>"
BASELINE = "provider string, suite string, case_id string, severity int"
SNAPSHOT = "config_id string, outcome string, n long, versions string"


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """tenant_id, doc_id, markdown of root/<tenant>/**/<doc>.md; a file right under root is an error at run time."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("value").alias("markdown"), F.col("_metadata.file_path").alias("path"))
    base = root.rstrip("/").split("://")[-1]
    parts = F.split(F.regexp_replace(F.col("path"), r"^.*?" + base.replace(".", r"\.") + "/", ""), "/")
    tenant = F.when(F.size(parts) < 2, F.raise_error(F.concat(F.lit("no tenant folder: "), "path"))).otherwise(F.element_at(parts, 1))
    return files.select(tenant.alias("tenant_id"), F.regexp_replace(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/"), r"\.md$", "").alias("doc_id"), "markdown")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector; an index is complete if there is none."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def fingerprint(version: str, model: str, dim: int, n_chunks: int) -> str:
    """8 hex digits that change with anything that makes a written index stale."""
    return hashlib.sha256(f"{version}|{model}|{dim}|{n_chunks}".encode()).hexdigest()[:8]


def union_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The documents of several trees; a document that two of them have fails the job that reads it."""
    return guard_duplicates(reduce(DataFrame.unionByName, [markdown_tree(spark, root) for root in roots]))


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def default_roots(spark: SparkSession, seed: str, generated: str) -> list[str]:
    """The seed tree, and the generated one if it is there."""
    return [seed, *([generated] if exists(spark, generated) else [])]


def write_index(path: str, tables: dict[str, DataFrame], meta: dict[str, str]) -> None:
    """Each table as Parquet under path, and last the meta table (with rows of each): without it, the index isn't whole."""
    rows = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(meta | {"rows": rows}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no whole index at {path}")
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def read_index(spark: SparkSession, path: str, expect: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a written index; one that lacks rows, or whose meta differs from what is expected, raises."""
    meta = read_meta(spark, path)
    if wrong := {k: (meta.get(k), v) for k, v in expect.items() if meta.get(k) != v}:
        raise ValueError(f"the index at {path} is of another kind: {wrong}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["rows"]}
    if short := [name for name, df in tables.items() if df.count() != meta["rows"][name]]:
        raise ValueError(f"the index at {path} isn't whole: {', '.join(short)}")
    return tables


def write_testset(cases: DataFrame, path: str) -> None:
    write_ndjson(cases, path)


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    return read_ndjson(spark, path, TESTSET)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.jsonl of a folder."""
    return spark.read.schema(LABELS).option("pathGlobFilter", "*.jsonl").json(folder)


def read_traps(spark: SparkSession, folder: str) -> DataFrame:
    """Traps, one to a YAML or JSON file; a key that lacks or an id that comes twice raises. They are few and read on the driver."""
    files = spark.read.option("pathGlobFilter", "*.{yaml,yml,json}").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    rows = []
    for r in sorted(files.collect(), key=lambda r: r["name"]):
        raw = _yaml(r["value"]) if not r["name"].endswith(".json") else json.loads(r["value"])
        if lacking := sorted(set(TRAP_KEYS) - set(raw)):
            raise ValueError(f"{r['name']} lacks {', '.join(lacking)}")
        detect = raw.get("detect") or {}
        lists = [list(map(str, detect.get(k) or [])) for k in ("must_contain_any", "must_not_contain", "acceptable_refusal_markers")]
        rows.append((*(str(raw[k]) for k in TRAP_KEYS), bool(detect.get("must_not_contain_confident_claim")), *lists))
    ids = [r[0] for r in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"traps with one id: {', '.join(twice)}")
    return spark.createDataFrame(rows, TRAPS)


def _yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text)


def write_baseline(failing: DataFrame, path: str, provider: str) -> None:
    """Failing findings (suite, case_id, severity) of a provider, beside those of others."""
    failing.select(F.lit(provider).alias("provider"), "suite", "case_id", F.col("severity").cast("int").alias("severity")).write.mode("overwrite").json(f"{path}/{provider}")


def read_baseline(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Empty where none was written."""
    where = f"{path}/{provider}"
    return spark.read.schema(BASELINE).json(where) if exists(spark, where) else spark.createDataFrame([], BASELINE)


def write_snapshot(counts: DataFrame, versions: dict[str, str], path: str) -> None:
    """Outcomes of a sweep (config_id, outcome, n) and what they came from."""
    counts.select("config_id", "outcome", F.col("n").cast("long").alias("n"), F.lit(json.dumps(versions, sort_keys=True)).alias("versions")).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]] | None:
    """The counts and their versions; None where none was written."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(SNAPSHOT).json(path)
    first = rows.select("versions").first()
    return rows.drop("versions"), json.loads(first["versions"]) if first else {}


def write_traces(traces: DataFrame, path: str) -> None:
    """Parquet, dealt by configuration; those that are there of the configurations written are replaced, so that a run that is
    repeated leaves one trace for each id."""
    traces.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_hash").parquet(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_diffs(diffs: DataFrame, path: str) -> None:
    write_ndjson(diffs, path)


def schema_json(df: DataFrame) -> str:
    """The schema of a table, for readers elsewhere."""
    return json.dumps(json.loads(df.schema.json()), indent=1, sort_keys=True)
