"""The whole way from texts to sanitized texts: detect, fuse, judge, mask, report.

``sanitize`` unites what the rules, the name model and, if given, a visual
detector have found, fuses it, masks what the policy doesn't allow and returns a row
for each document with what a caller may see: no column but the masked text holds
any words of the original.

Defined results: a row whose text is null, whose id is null or whose id another row
has too isn't sanitized; ``error`` says why, and its text is null, or the original
if ``on_error`` is ``raw``. An empty text is sanitized and empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import entity
from quillsift.operators import detect, fuse, names, redact
from quillsift.sources import tables

#: What a caller may see of a region.
PUBLIC = ("id", "type", "tag", "risk", "confidence", "sources", "detail", "token", "action", "x0", "y0", "x1", "y1")
ORDER = ("detector", "ln", "wi", "wi_to", "type", "text")


def model_hits(docs: DataFrame) -> DataFrame:
    """Names after fixed phrases, aligned with the words: one row for each place."""
    first, last = F.try_element_at("words", F.lit(1)), F.try_element_at("words", F.lit(-1))
    return names.align_texts(docs).select(
        "*", F.lit("privacy_filter").alias("source"), F.lit(0).alias("detector"),
        first["ln"].alias("ln"), first["wi"].alias("wi"), last["ln"].alias("ln_to"), last["wi"].alias("wi_to"),
    )


def detections(docs: DataFrame, policy: dict[str, str] | None = None, unicode_labels: bool = False) -> DataFrame:
    """All detections of the rules and the model in ``docs`` (doc_id, text), with source, places, boxes, risk and action."""
    return judged(rule_hits(detect.detect_all(docs, unicode_labels=unicode_labels)).unionByName(model_hits(docs)), policy)


def rule_hits(ruled: DataFrame) -> DataFrame:
    """Hits of the rules as the union has them, with the words they cover."""
    words = F.transform(F.sequence("wi", "wi_to"), lambda w: F.struct(F.col("ln").alias("ln"), w.alias("wi")))
    return ruled.drop("risk", "action").withColumns({"ln_to": F.col("ln"), "words": words})


def judged(found: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """Add risk and action."""
    return found.withColumn("risk", entity.risk(F.col("type"))).withColumn("action", entity.action(F.col("risk"), policy))


def masked_words(found: DataFrame) -> DataFrame:
    """(doc_id, ln, wi, wi_to) of the words that the policy doesn't allow."""
    return found.filter(F.col("action") != "allow").select("doc_id", F.inline("words")).select("doc_id", "ln", "wi", F.col("wi").alias("wi_to"))


def union_visual(found: DataFrame, visual: DataFrame | None) -> DataFrame:
    """Detections and, if there are any, visual ones (doc_id, type, confidence, x0..y1), which cover no words."""
    cols = ["doc_id", "type", "source", "confidence", "x0", "y0", "x1", "y1", *(c for c in ORDER if c != "type"), "words", "action"]
    every = found.select(cols)
    if visual is not None:
        none = {"words": F.array().cast(dict(found.dtypes)["words"]), "action": F.lit("allow")}
        more = visual.withColumns({"source": F.lit("visual"), "detector": F.lit(0), "text": F.lit("")} | none | {c: F.lit(0).cast("long") for c in ("ln", "wi", "wi_to")})
        every = every.unionByName(more.select(cols))
    return every


def fused(found: DataFrame, visual: DataFrame | None = None, policy: dict[str, str] | None = None) -> DataFrame:
    """Fused regions of detections and of visual ones (doc_id, type, confidence, x0..y1)."""
    return fuse.fuse(fuse.arrived(union_visual(found, visual), *ORDER), policy)


def summaries(found: DataFrame, visual: DataFrame | None = None, policy: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, masks, regions) of each document with a detection: the words that the policy doesn't allow, and its fused regions.

    A document's detections are gathered once, and both are made of that.
    """
    gathered = fuse.frames(fuse.arrived(union_visual(found, visual), *ORDER), "words", "action")
    covered = F.flatten(F.transform(F.filter("cells", lambda c: c["action"] != "allow"), lambda c: c["words"]))
    masks = F.transform(F.array_distinct(covered), lambda w: F.struct(w["ln"].alias("ln"), w["wi"].alias("wi"), F.lit(redact.BLOCK).alias("t")))
    return gathered.select("doc_id", masks.alias("masks"), fuse.regions(F.col("cells"), policy).alias("regions"))


def sanitize(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", policy: dict[str, str] | None = None,
    visual: DataFrame | None = None, on_error: str = "drop", unicode_labels: bool = False,
) -> DataFrame:
    """(id, text, sanitized, error, n_masked, total, critical, high, medium, low, detections) of every row of ``df``.

    ``on_error``: ``drop`` (no text) or ``raw`` (the original) where a row can't be sanitized.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = summaries(detections(own.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), policy, unicode_labels), visual, policy)
    return masked_rows(own, found, text_col, id_col, on_error)


def masked_rows(own: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id", on_error: str = "drop") -> DataFrame:
    """The rows of ``sanitize``, of texts (doc_id, text) and their ``summaries``."""
    if on_error not in ("drop", "raw"):
        raise ValueError("on_error is drop or raw")
    once = own.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    out = own.join(once.join(found.hint("merge"), "doc_id", "left").hint("merge"), "doc_id", "left")
    error = F.when(F.col("doc_id").isNull(), "no id").when(F.col("n_rows") > 1, "repeated id").when(F.col("text").isNull(), "no text")
    out = out.withColumn("error", error)
    # only texts that change go to Python workers and back
    good = lambda c: F.when(F.col("error").isNull(), F.col(c))
    out = out.withColumns({"masks": good("masks"), "regions": good("regions")})
    out = out.withColumn("changed", redact.mask_column(F.when(F.size("masks") > 0, F.col("text")), F.col("masks")))
    kept = F.when(F.col("error").isNull(), F.coalesce("changed", "text"))
    seen = F.transform("regions", lambda r: F.struct(*(r[c].alias(c) for c in PUBLIC)))
    out = out.withColumn("seen", seen)
    n = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    at = lambda level: n(F.filter("seen", lambda r: r["risk"] == level)).alias(level)
    return out.select(
        F.col("doc_id").alias(id_col), (F.coalesce(kept, F.col("text")) if on_error == "raw" else kept).alias(text_col), F.col("error").isNull().alias("sanitized"), "error",
        n("masks").alias("n_masked"), n("seen").alias("total"), *map(at, entity.RANKS), F.coalesce("seen", F.array().cast(dict(out.dtypes)["seen"])).alias("detections"),
    )


def require_fields(df: DataFrame, fields: dict[str, Column], into: str = "error") -> DataFrame:
    """Add ``into``: the first of ``fields`` that a request lacks (null or blank), in their order, or null."""
    missing = [F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(f"{name} is required")) for name, c in fields.items()]
    return df.withColumn(into, F.coalesce(*missing))
