"""The queries op1_ to op13_: thin calls of the operators with production parameters. Results of small inputs come in few
partitions, see `compact`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelens.session import ship

from .common import compact, new_folder, table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spotsigs

    docs = table(spark, sf_dir, "documents")
    return compact(spotsigs.digest(spotsigs.fingerprints(docs)), docs)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    paths, ledger = secrets.update(docs, new_folder(spark, "ledger"))
    return compact(secrets.digest(secrets.findings(paths, ledger, secrets.RULES)), docs)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return compact(ngram_join.link_components(docs), docs)


def op4_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_pack
    from .bpe_automaton import public_file

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    files = token_pack.write_files(docs, public_file(spark, "byte_bpe_50k.json"), token_pack.pack_folder(spark))
    return compact(token_pack.digest(token_pack.read_documents(files)), docs)


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_pu

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return compact(quality_pu.predict(docs, table(spark, sf_dir, "labels")), docs)


def op6_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_density

    ship(spark)
    pages = table(spark, sf_dir, "pages")
    return compact(html_density.extract(pages), pages)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rlz

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return compact(rlz.spans_digest(rlz.dedup_substrings(docs)), docs)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe_automaton as bpe

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return compact(bpe.digest(bpe.encode_decode(docs, bpe.public_file(spark, "word_bpe_49k.json"))), docs)


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_templates

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return line_templates.digest(line_templates.drop_recurring(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    docs = table(spark, sf_dir, "documents")
    return compact(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_repair

    ship(spark)
    return conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations"))))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format

    ship(spark)
    own = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = own.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema)
    return chat_format.digest(chat_format.format_chats(own.unionByName(added)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import runs

    ship(spark)
    return runs.digest(runs.find_runs(runs.plant(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return dict(oracle.SQL)
