"""Masking texts and reporting on what was masked."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import entity

BLOCK = "█████"
CONFIG = {"severity": entity.RANKS}


def redact(lined: DataFrame, hits: DataFrame, tagged: bool = False) -> DataFrame:
    """(doc_id, text) with the words of ``hits`` (doc_id, ln, wi, wi_to, and token if tagged) replaced.

    Overlapping hits mask a word once; tagged, the least token stands. Lines without
    a hit stay as they are; in the others, words are rejoined by single blanks.
    """
    token = F.col("token") if tagged else F.lit(BLOCK)
    each = hits.select("doc_id", "ln", F.explode(F.sequence("wi", "wi_to")).alias("w"), token.alias("t"))
    masks = each.groupBy("doc_id", "ln", "w").agg(F.min("t").alias("t")).groupBy("doc_id", "ln").agg(F.map_from_entries(F.collect_list(F.struct("w", "t"))).alias("m"))
    met = lined.select("doc_id", "ln", "line", "ws").join(masks.hint("merge"), ["doc_id", "ln"], "left")
    new = F.transform("ws", lambda w, i: F.coalesce(F.try_element_at("m", i.cast("long")), w))
    line = F.when(F.col("m").isNull(), F.col("line")).otherwise(F.array_join(new, " "))
    gathered = met.select("doc_id", "ln", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("ls"))
    return gathered.select("doc_id", F.array_join(F.col("ls.line"), "\n").alias("text"))


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def masked_text(text: str, masks: Iterable[tuple[int, int, str]]) -> str:
    """The text with words (line, place in it, token) replaced; in lines that have any, words are rejoined by single blanks."""
    by_line: dict[int, dict[int, str]] = {}
    for ln, wi, token in masks:
        words = by_line.setdefault(ln, {})
        words[wi] = min(token, words.get(wi, token))
    lines = text.split("\n")
    for ln, words in by_line.items():
        lines[ln] = " ".join(words.get(i, w) for i, w in enumerate(_WORD.findall(lines[ln])))
    return "\n".join(lines)


def mask_column(text: Column, masks: Column) -> Column:
    """``masked_text`` of whole texts; ``masks``: array of (ln, wi, t). Texts that aren't to be changed should be null, as they then stay where they are."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked_text(t, ((m["ln"], m["wi"], m["t"]) for m in ms)) for t, ms in zip(texts, every, strict=True)], dtype=object)

    return masked(text, masks)


def mask(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` with the words of ``hits`` (doc_id, ln, wi, wi_to, and token if there is one) replaced, like ``redact``, but whole.

    The masks go to the texts: a text moves once at most, and its lines never do. Null texts are left out.
    """
    token = F.col("token") if "token" in hits.columns else F.lit(BLOCK)
    cell = F.transform(F.sequence("wi", "wi_to"), lambda w: F.struct(F.col("ln").alias("ln"), w.alias("wi"), token.alias("t")))
    masks = hits.groupBy("doc_id").agg(F.flatten(F.collect_list(cell)).alias("_m"))
    met = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(masks.hint("merge"), "doc_id", "left")
    changed = mask_column(F.when(F.col("_m").isNotNull(), F.col("text")), "_m")
    return met.select("doc_id", F.coalesce(changed, "text").alias("text"))


def severity(detections: DataFrame, *by: str) -> DataFrame:
    """Number of detections in all and at each level."""
    return detections.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("risk") == r).alias(r) for r in entity.RANKS))


def manifest(fused: DataFrame, strict_constants: bool = False, sanitized: Column | None = None, about: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, total, levels, manifest): one JSON document a frame, without any original text.

    The exposure follows ``sanitized`` (default: true), or is the constant of a
    protected frame if ``strict_constants``. ``about`` (the file's name, the frame's
    size, the time taken and so on) are constants of a frame, which lead the document.
    """
    safe = F.lit(True) if sanitized is None or strict_constants else sanitized
    box = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    cells = F.array_sort(F.collect_list(F.struct("place", "id", "tag", "type", "risk", "confidence", "token", F.col("detail").alias("source"), box, "action")))
    held = [F.first(c).alias(f"_{k}") for k, c in (about or {}).items()]
    out = fused.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("risk") == r).alias(r) for r in entity.RANKS), cells.alias("detections"), *held)
    body = F.struct(
        F.lit("1.0").alias("manifestVersion"), *(F.col(f"_{k}").alias(k) for k in about or {}),
        F.when(safe, "PROTECTED").otherwise("UNPROTECTED").alias("privacyStatus"), F.when(safe, "NONE").otherwise("RAW").alias("cloudExposure"),
        F.struct(F.col("total").alias("totalRegions"), *entity.RANKS).alias("summary"), F.transform("detections", lambda d: d.dropFields("place")).alias("detections"),
    )
    return out.select("doc_id", "total", *entity.RANKS, F.to_json(body).alias("manifest"))


def write_manifest(manifests: DataFrame, path: str) -> None:
    """Append the documents, a line each, to files of JSON."""
    manifests.select(F.col("manifest").alias("value")).write.mode("append").text(path)


def audit(summary: DataFrame, sanitized: Column, about: dict[str, Column] | None = None, error: Column | None = None) -> DataFrame:
    """One append-only row a frame: counts at each level, whether raw data left, why, and ``about`` (size, time taken, runtime)."""
    counts = [F.col("total").alias("detections"), *entity.RANKS]
    return summary.select(
        "doc_id", *(c.alias(k) for k, c in (about or {}).items()), *counts, sanitized.alias("sanitized"), (~sanitized).alias("cloud_exposure"),
        (F.lit(None).cast("string") if error is None else error).alias("error"),
    )


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows; nothing that is there is ever changed."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def fail_closed(df: DataFrame, required: str) -> DataFrame:
    """Stop the query at a row whose ``required`` output is null or empty."""
    ok = F.col(required).isNotNull() & (F.length(required) > 0)
    return df.withColumn(required, F.when(ok, F.col(required)).otherwise(F.raise_error(F.lit(f"no output in {required}"))))
