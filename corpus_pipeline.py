"""The corpus pipeline: documents through language ID, near-dedup, decontamination, PII and mixing.

Each stage works on all rows its predecessor kept, and reads them back from the
table the predecessor wrote. Columns beyond those of documents are set aside while a
stage works, so that none is lost or overwritten, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import decontaminate, language_id, mixing, near_copies, surrogates
from quillsift.llm.common import load, materialize
from quillsift.llm.registry import pii_key

#: The columns that stages read; all others are carried in one struct.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
REST = "_quillsift_rest"


def set_aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], results: tuple[str, ...] = ()) -> DataFrame:
    """``stage`` of the own columns of ``docs``: all of its columns, in their order, and then ``results`` (``mix_`` first, if a name is taken)."""
    rest = [c for c in docs.columns if c not in OWN]
    own = [F.col(c) for c in docs.columns if c in OWN]
    found = stage(docs.select(*own, *([F.struct(*rest).alias(REST)] if rest else [])))
    named = {r: r for r in results}
    for r in results:
        while named[r] in docs.columns:
            named[r] = f"mix_{named[r]}"
    return found.select(*(F.col(REST)[c].alias(c) if c in rest else F.col(c) for c in docs.columns), *(F.col(r).alias(n) for r, n in named.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or so ambiguous that no language has half the belief."""
    model = language_id.fit(docs)
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & ~(F.col("ambiguous") & (F.col("score") < 0.5))
    return set_aside(docs, lambda own: language_id.identify(own, model, ambiguous_below=0.1).filter(sure))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles alike to 0.8 or more, all such pairs."""
    return set_aside(docs, near_copies.deduplicate)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return set_aside(docs, lambda own: decontaminate.decontaminate(own, load(spark, sf_dir, "benchmark")))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the new text."""
    long = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return set_aside(docs, lambda own: surrogates.pseudonymize(own, pii_key(spark)).withColumn("n_chars", long))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of copies and the words they add up to."""
    results = ("size", "source_size", "target", "copies", "taken")
    return set_aside(docs, lambda own: mixing.mix(own).filter(F.col("copies") > 0), results)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii_surrogates", replace_pii),
    ("source_mixing", mix_sources),
]

#: No SQL: learned language models and keyed surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the table documents."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
