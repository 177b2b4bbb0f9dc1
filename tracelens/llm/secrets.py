"""Secret scan with an incremental blob ledger.

Every text is content-addressed (SHA-256 of its UTF-8 bytes). The ledger holds, for each blob and rule version, the spans
found; a scan looks only at blob and rule-version pairs that the ledger doesn't have, once for each different blob however
many paths or versions carry it, and findings are joined back to every path. New rules or raised versions rescan all blobs
for those rules alone; unchanged history costs a join.

The ledger is a Parquet table (see `update`): each scan appends what it found, empty findings too, and reads the whole back.

Base rules are those of the contract; the method's own add the tokens of known issuers, private keys and signed web tokens.
Null or empty text is the empty blob, without findings. Very long texts are scanned whole. Equal rows each get the findings
of their blob; rows without doc_id get theirs too. Ties: kinds that start at one place are ordered as the rules are. An empty
table gives no rows and an empty ledger. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, cut, slices, texts_of

LEDGER = "blob string, rule string, version int, spans array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, of which those with `least` characters in `group` count.

    `hint`: strings of which a text must hold one, in lower case if fold is set; it only saves time.
    """

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: tuple[str, ...] = ()
    fold: bool = False


#: In the order in which kinds sort at one start. Runs of one character class are maximal, so their least length can stand
#: in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)


#: Formats that issuers publish for their tokens and keys.
ISSUED_RULES = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27, ("PRIVATE KEY-----",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 35, ("eyJ",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", 0, 39, ("AIza",)),
    Rule("stripe", 1, r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24, ("k_live_",)),
)
RULES = BASE_RULES + ISSUED_RULES


def find(rule: Rule, compiled: re.Pattern, text: str, folded: str) -> list[tuple[int, int]]:
    if rule.hint and not any(h in (folded if rule.fold else text) for h in rule.hint):
        return []
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: re.compile(r.pattern, re.ASCII) for r in rules}
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for blob, text, todo in zip(part.column("blob").to_pylist(), texts_of(part.column("text")), part.column("todo").to_pylist(), strict=True):
                    folded = text.lower()
                    for r in rules:
                        if r.name in todo:
                            rows.append((blob, r.name, r.version, [{"start": a, "end": b} for a, b in find(r, compiled[r.name], text, folded)]))
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["blob", "rule", "version", "spans"])

    return run


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): paths has doc_id and blob of each row of docs(doc_id, text); ledger has all blobs scanned so far."""
    paths, found = _unseen(docs, ledger, rules)
    return paths, found if ledger is None else ledger.unionByName(found)


def _unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """paths, and a ledger's rows of every pair of blob and rule version that `ledger` lacks.

    doc_id stands for a path at a version. Of equal blobs, the row of least doc_id is read.
    """
    spark = docs.sparkSession
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob")
    paths = docs.select("doc_id", blob)
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    current = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", current)
    else:
        wanted = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")  # as many as there are rules
        seen = ledger.join(F.broadcast(wanted), ["rule", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    row, wants = docs.select("doc_id", "text", blob).alias("row"), todo.select("doc_id", "blob", "todo").alias("wants")
    text = row.join(wants, (F.col("row.blob") == F.col("wants.blob")) & F.col("row.doc_id").eqNullSafe(F.col("wants.doc_id")))
    return paths, text.select("row.blob", "todo", "text").mapInArrow(_scan(rules), LEDGER)


def update(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): scans what the ledger at that path (a folder that driver and executors share; new or from earlier scans)
    hasn't seen and appends it there; ledger is the whole table as it is then, each pair of blob and rule version once."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    known = spark.read.schema(LEDGER).parquet(ledger_path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    paths, found = _unseen(docs, known, rules)
    compact(found, docs).write.mode("append").parquet(ledger_path)
    # rows without doc_id, equal rows and two scans at once can add a pair twice
    return paths, spark.read.schema(LEDGER).parquet(ledger_path)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, blob, and spans: array<struct<start, place, end, kind>> sorted, of the current rules, for every path."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    hit = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"), order[F.col("rule")].alias("place"), F.col("rule").alias("kind"), "version")
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.name) & (F.col("version") == r.version))
    spans = cut(hit.where(current).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", "place", "s.end", "kind"))).alias("spans")))
    return paths.join(spans, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin([r.name for r in BASE_RULES])), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(base.cast("binary"), 256).alias("base_sha256"), text.alias("spans"), "blob")

