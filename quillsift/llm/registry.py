"""Queries of the corpus operators: op<N>_<name>(spark, sf_dir) over whole tables.

The operators keep their own interfaces; a query here applies one of them with
production parameters and picks the columns of its result.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import (
    chat_format, decontaminate, language_id, lexical_search, line_clean, mixing, piece_table, rule_ensemble, simhash, suffix_dedup, surrogates, token_spans, word_runs,
)
from quillsift.llm.common import held_out, load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates, from the session's settings; if there is none, one drawn for this session alone."""
    name = "spark.quillsift.pii.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs, pii_key(spark))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sized = mixing.materialize(docs.select("doc_id", "source", mixing.word_count().alias("size")))
    return mixing.mix(sized, sized=sized).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.attribute(load(spark, sf_dir, "documents"))


def op6_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_clean.clean(load(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_ensemble.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(text).alias("prompt"), F.lit(text).alias("completion"))
    talks = load(spark, sf_dir, "conversations")
    own = talks.select("conv_id", *(c for c in talks.columns if c in chat_format.COLUMNS))
    # the records of both in one table, each converted by its own fingerprint; null fields don't change the table's layout, if it has one
    paths = tuple(sorted(chat_format.field_paths(own.drop("conv_id").schema)))
    default = paths if chat_format.fingerprint(list(paths)) in chat_format.MAPPINGS else None
    if default is None:
        chat_format.all_turns(own, "conv_id")  # an error, unless records have layouts of their own
    return chat_format.read_back(chat_format.all_turns(own.unionByName(probe, allowMissingColumns=True), "conv_id", default))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_table.encode(load(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.find_runs(load(spark, sf_dir, "documents").select("doc_id", "text"), word_runs.periodic_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.n) div (-best.p)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_source_mixing": op4_source_mixing,
    "op5_token_attribution": op5_token_attribution,
    "op6_line_cleaning": op6_line_cleaning,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_lexical_search": op11_lexical_search,
    "op12_piece_table": op12_piece_table,
    "op13_word_runs": op13_word_runs,
}

ORACLES = {
    "op6_line_cleaning": line_clean.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
}
