"""An engine over one collection: what an index build stores, runs of questions under configurations, and traces by id."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .functions import text as T
from .operators import generate, ingest, pruned, retrieve, stages
from .plans import provenance
from .plans.config import compose, configs, normalise, plan
from .session import MANY, bucketed, buckets, cut, small
from .sources import files


class Engine:
    """chunks(chunk_id, tenant_id, doc_id, ordinal, text) and the questions(query_id, tenant_id, query) put to them.

    Questions may have a column previous: the turn before, null if there is none. A question that points to it is then also put as
    it reads rewritten, and a configuration that rewrites gets that one. Both are rows of `questions`, under ids of their own;
    results have the questions' ids.

    Tables are computed when first asked for and kept in the shared folder; `stored` gives those that an index on disk has.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, questions: DataFrame, stored: dict[str, DataFrame] | None = None):
        self.spark, self.given_chunks, self.given_questions, self.stored = spark, chunks, questions, stored or {}

    @cached_property
    def chunks(self) -> DataFrame:
        return self.stored.get("chunks") or bucketed(self.given_chunks, "chunk_id", self.parts)

    @cached_property
    def parts(self) -> int:
        """Buckets of the tables that are kept by chunk: chunks, postings and concepts. What is summed for a chunk is then summed where
        the chunk is, and is ranked there before anything is shuffled."""
        return buckets(self.given_chunks)

    def by_chunk(self, df: DataFrame) -> DataFrame:
        """Rows made from the chunks' own, kept in the same buckets; those of a stored index, which has none, as they come."""
        return cut(df) if "chunks" in self.stored else bucketed(df, "chunk_id", self.parts, dealt=True)

    @cached_property
    def asks(self) -> DataFrame | None:
        """ask_id, query_id, rewritten, only (whether there is no rewritten form), tenant_id, query of questions with a turn before;
        None if the questions have none."""
        if "previous" not in self.given_questions.columns:
            return None
        q = cut(self.given_questions.select("query_id", "tenant_id", "query", "previous"))
        said = [q.select(F.explode_outer(T.content_tokens(c)).alias("token")) for c in ("query", "previous")]
        words = said[0].union(said[1]).where("token is not null")
        new = stages.rewrite(q.select("query_id", "query", F.coalesce("previous", F.lit("")).alias("previous")), self._with(words), self.weights)
        j = q.select("query_id", "tenant_id", "query").join(new.select("query_id", F.col("rewritten").alias("text")), "query_id")
        forms = F.array(F.struct(F.lit(False).alias("rewritten"), F.col("query").alias("q")), F.struct(F.lit(True).alias("rewritten"), F.when(F.col("text") != F.col("query"), F.col("text")).alias("q")))
        rows = j.withColumn("only", F.col("text") == F.col("query")).select("query_id", "only", "tenant_id", F.explode(forms).alias("f")).where("f.q is not null")
        return cut(rows.select(F.xxhash64("query_id", "f.rewritten").alias("ask_id"), "query_id", "f.rewritten", "only", "tenant_id", F.col("f.q").alias("query")))

    def chosen(self, cfg: DataFrame) -> DataFrame:
        """config_id, ask_id, query_id: in which form each configuration puts each question."""
        both = self.asks.select("ask_id", "query_id", "rewritten", "only").crossJoin(F.broadcast(cfg.select("config_id", "rewrite")))
        return both.where(F.col("rewritten") == (F.col("rewrite") & ~F.col("only"))).select("config_id", "ask_id", "query_id")

    @cached_property
    def questions(self) -> DataFrame:
        if self.asks is not None:
            return self.asks.select(F.col("ask_id").alias("query_id"), "tenant_id", "query")
        return cut(self.given_questions)

    @cached_property
    def postings(self) -> DataFrame:
        return self.stored.get("postings") or self.by_chunk(retrieve.postings(self.chunks))

    @cached_property
    def blocks(self) -> DataFrame:
        """The postings in blocks, for pruned retrieval."""
        return self.stored.get("blocks") or cut(pruned.blocks(self.postings))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._with(retrieve.query_terms(self.questions).select(F.col("term").alias("token")))

    @cached_property
    def chunk_vocabulary(self) -> DataFrame:
        return self.stored.get("vocabulary") or cut(ingest.with_concept(self.terms))

    @cached_property
    def terms(self) -> DataFrame:
        """The chunks' terms, and in how many chunks each stands."""
        return cut(retrieve.terms(self.postings))

    def _with(self, words: DataFrame) -> DataFrame:
        """The chunks' vocabulary and that of words(token) that they don't have."""
        words = cut(words.distinct())
        known = self.chunk_vocabulary.select("token").join(small(words, MANY), "token", "left_semi")
        return self.chunk_vocabulary.union(cut(ingest.vocabulary(words.join(known, "token", "left_anti"))))

    @cached_property
    def own(self) -> DataFrame:
        """Chunks' concepts."""
        return self.stored.get("concepts") or self.by_chunk(retrieve.chunk_concepts(self.postings, counted=self.terms))

    @cached_property
    def weights(self) -> DataFrame:
        return self.stored.get("weights") or cut(retrieve.concept_idf(self.own, self.chunks))

    @cached_property
    def concepts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Chunks' concepts, questions' concepts, idf."""
        return self.own, cut(retrieve.asked_concepts(self.questions, self.vocabulary)), self.weights

    def pairs(self) -> DataFrame:
        """Each question with every chunk in its scope that shares a concept with it: not kept, as the legs rank it at once."""
        own, asked, weights = self.concepts
        return retrieve.concept_pairs(self.chunks, self.questions, own, asked, weights)

    @cached_property
    def lexical(self) -> DataFrame:
        return cut(retrieve.bm25(self.chunks, self.questions, posted=self.postings))

    @cached_property
    def semantic(self) -> DataFrame:
        """All pairs ranked: their scores are summed where the chunk is, and cost less than candidates that are met again."""
        return cut(retrieve.concept_knn(self.pairs()))

    @cached_property
    def legs(self) -> DataFrame:
        return cut(stages.legs(self.lexical, self.semantic))

    @cached_property
    def rerank_scores(self) -> DataFrame:
        own, asked, weights = self.concepts
        covered = retrieve.coverage_of(self.legs, self.chunks, own, asked, weights)
        return cut(stages.rerank_scores(self.legs, covered, self.questions, self.chunks))

    def retrieve(self, names: list[str]) -> dict[str, DataFrame]:
        """Candidates, decisions and final order under each configuration named."""
        return self._named(self._retrieve(names))

    def run(self, names: list[str]) -> dict[str, DataFrame]:
        """The same, and contexts and answers."""
        return self._named(self._run(names))

    def _named(self, r: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Results under the questions' own ids; questions are then the forms in which the first configuration puts them."""
        if self.asks is None:
            return r
        own = cut(self.chosen(r["configs"]))
        for name in {"cand", "decided", "ranked", "ctx", "answers"} & r.keys():
            ids_ = own.select("config_id", F.col("ask_id").alias("query_id"), F.col("query_id").alias("own_id"))
            r[name] = r[name].join(ids_, ["config_id", "query_id"]).withColumn("query_id", F.col("own_id")).drop("own_id")
        r["forms"] = own.join(self.asks.select("ask_id", "tenant_id", "query"), "ask_id").select("config_id", "query_id", "tenant_id", "query")
        return r

    def _retrieve(self, names: list[str]) -> dict[str, DataFrame]:
        cfg = configs(self.spark, names)
        cand = stages.fuse(self.legs, cfg)
        if self.asks is not None:
            cand = cand.join(self.chosen(cfg).select("config_id", F.col("ask_id").alias("query_id")), ["config_id", "query_id"], "left_semi")
        cand = cut(cand)
        decided = cut(stages.rerank_decision(stages.gate(cand, cfg), cfg))
        ranked = cut(stages.rerank(cand, decided, self.rerank_scores, cfg))
        return {"chunks": self.chunks, "questions": self.questions, "configs": cfg, "legs": self.legs, "cand": cand, "decided": decided, "ranked": ranked}

    def _run(self, names: list[str]) -> dict[str, DataFrame]:
        r = self._retrieve(names)
        own, asked, weights = self.concepts
        r["ctx"] = cut(stages.context(r["ranked"], r["chunks"], r["configs"]))
        if self.asks is None:
            runs = r["questions"].select("query_id").crossJoin(F.broadcast(r["configs"].select("config_id")))
        else:
            runs = self.chosen(r["configs"]).select("config_id", F.col("ask_id").alias("query_id"))
        terms = cut(generate.weighted_terms(r["questions"], asked, weights, r["chunks"]))
        r["answers"] = cut(generate.answers(runs, r["ctx"], r["decided"], r["configs"], r["questions"], r["chunks"], own, self.vocabulary, terms))
        r["own"], r["asked"] = own, asked
        return r

    def query(self, names: list[str] | None = None, corpus: str = "corpus") -> DataFrame:
        """One nested trace for each question and configuration, with its id and version stamp. Names that give no configuration
        raise ValueError."""
        names = names or ["baseline"]
        _, errors = plan(names)
        if errors:
            raise ValueError("; ".join(errors.values()))
        r = self.run(names)
        traces = generate.traces(r["ranked"], r["ctx"], r["answers"]).join(generate.run_stages(r["configs"], r["decided"], r["answers"]), ["config_id", "query_id"])
        stamps = self.spark.createDataFrame([(normalise(n), compose(n).hash(), *(provenance.versions(compose(n), corpus)[k] for k in provenance.report.COMPARED)) for n in names], "config_id string, config_hash string, " + ", ".join(f"{k} string" for k in provenance.report.COMPARED))
        put = r["questions"].select("query_id", "tenant_id", "query").crossJoin(F.broadcast(r["configs"].select("config_id"))) if self.asks is None else r["forms"]
        named = traces.join(F.broadcast(stamps), "config_id").join(put.select("config_id", "query_id", "tenant_id", "query"), ["config_id", "query_id"])
        versions = F.struct(*provenance.report.COMPARED).alias("versions")
        key = ids.content_id(F.col("config_hash"), F.col("tenant_id"), F.col("query_id").cast("string"), F.col("query"))
        return named.select(key.alias("trace_id"), "config_id", "config_hash", "query_id", "tenant_id", "query", "status", "hedged", "answer", "citations", "candidates", "stages", versions)

    def meta(self) -> DataFrame:
        """n_chunks, n_docs and tenants, the global one left out."""
        from .sources.fixtures import GLOBAL

        shown = F.sort_array(F.collect_set(F.when(F.col("tenant_id") != GLOBAL, F.col("tenant_id"))))
        return self.chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("tenant_id", "doc_id").alias("n_docs"), shown.alias("tenants"))

    def save(self, path: str, version: str, model: str = "concept") -> None:
        """Writes the index: chunks, postings, chunks' concepts and what describes them."""
        files.write_index(path, {"chunks": self.chunks, "postings": self.postings, "concepts": self.concepts[0]}, {"version": version, "model": model, "kind": "concept"})

    @classmethod
    def load(cls, spark: SparkSession, path: str, questions: DataFrame, model: str = "concept") -> Engine:
        """An engine over a written index; one that isn't whole, or was made for another model, raises."""
        stored = files.read_index(spark, path, {"model": model, "kind": "concept"})
        return cls(spark, stored["chunks"], questions, stored)


def trace(traces: DataFrame, trace_id: str) -> DataFrame:
    """The trace of an id; what isn't an id raises."""
    if len(trace_id) != 26 or not all(c in ids.ALPHABET for c in trace_id):
        raise ValueError("no trace id")
    return traces.where(F.col("trace_id") == trace_id)


def context_chunks(traces: DataFrame) -> DataFrame:
    """trace_id, final_rank, chunk_id of what each run read, in order."""
    return traces.select("trace_id", F.explode("candidates").alias("c")).where("c.rejected_by is null and c.final_rank < 1000000").select("trace_id", "c.final_rank", "c.chunk_id")


def candidate(traces: DataFrame, chunk_id: str) -> DataFrame:
    """trace_id and the fate of one chunk in each run that had it."""
    return traces.select("trace_id", F.explode("candidates").alias("c")).where(F.col("c.chunk_id") == chunk_id).select("trace_id", "c.*")


def stage(traces: DataFrame, name: str) -> DataFrame:
    """trace_id and the record of one stage."""
    return traces.select("trace_id", F.explode("stages").alias("s")).where(F.col("s.stage") == name).select("trace_id", "s.*")


def foreign_chunks(traces: DataFrame, chunks: DataFrame) -> DataFrame:
    """trace_id, chunk_id, owner of candidates that the asking tenant may not see; empty if the filter holds."""
    from .sources.fixtures import GLOBAL

    c = traces.select("trace_id", "tenant_id", F.explode("candidates").alias("c")).select("trace_id", "tenant_id", "c.chunk_id")
    owned = c.join(chunks.select("chunk_id", F.col("tenant_id").alias("owner")), "chunk_id")
    return owned.where((F.col("owner") != F.col("tenant_id")) & (F.col("owner") != GLOBAL)).select("trace_id", "chunk_id", "owner")


def assert_scope(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates(tenant_id, chunk_id, ...) as they are; one of another tenant fails the job that reads it."""
    from .sources.fixtures import GLOBAL

    owned = candidates.join(chunks.select("chunk_id", F.col("tenant_id").alias("owner")), "chunk_id")
    held = (F.col("owner") == F.col("tenant_id")) | (F.col("owner") == GLOBAL)
    return owned.where(F.coalesce(F.assert_true(held, F.concat_ws(" ", F.lit("foreign chunk"), "chunk_id")).cast("string"), F.lit("")) == "").drop("owner")


def chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """Point lookup."""
    return chunks.where(F.col("chunk_id") == chunk_id)


def token_estimate(questions: DataFrame, each: int = 1900) -> DataFrame:
    """What a suite's run over questions will cost, before it is run: n, tokens."""
    return questions.agg(F.count("*").alias("n")).withColumn("tokens", F.col("n") * each)

