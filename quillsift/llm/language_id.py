"""Language identification by error-correcting output codes.

Every language gets a codeword of +1/-1 bits. One binary classifier over hashed
byte trigrams learns each bit, and a text is given the language whose codeword
costs the least under the classifiers' logistic losses, each bit weighted by how
reliable it was in training. Where the best codeword leads by little, the text is
flagged as ambiguous: by no more than half-and-half mixtures of two languages'
training texts usually have, and by less than nearly all texts of one language.

Defined results: a text that is null or has no letter is ``und`` with score 0; a
text with letters is given a learned language, however short; without any
labelled row every text is ``und``; with one language all texts with letters get
it. Repeated rows are predicted each on its own. Columns named like the results
are replaced; all others are kept. An empty table has an empty result. Whole texts
are read, a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import learnable, small_batches

DIMS = 4096
#: Rows turned into features at a time, and about as many bytes of text, which bounds a worker's memory.
ROWS, PART_BYTES = 128, 500_000
UNDETERMINED = "und"
#: Non-letters of ASCII become blanks; bytes of multi-byte characters stay.
_CLEAN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    """Learned bits: ``weights`` is DIMS x bits, ``codes`` is languages x bits. Below a lead of ``bound`` a text is ambiguous."""

    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    bound: float = 0.0


def features(texts: list[str]) -> np.ndarray:
    """Root frequencies of hashed byte trigrams of whole lower-cased texts, a row each."""
    raw = [t.lower().encode("utf-8", "replace").translate(_CLEAN) for t in texts]
    out = np.zeros((len(raw), DIMS), dtype=np.float32)
    start = 0
    while start < len(raw):
        stop, size = start, 0
        while stop < len(raw) and (stop == start or size + len(raw[stop]) < PART_BYTES):
            size += len(raw[stop]) + 2
            stop += 1
        part = raw[start:stop]
        flat = np.frombuffer(b"  ".join([b"", *part, b""]), dtype=np.uint8)
        sizes = np.fromiter((len(p) + 2 for p in part), dtype=np.int64, count=len(part))
        doc = np.repeat(np.arange(len(part), dtype=np.int64), sizes)
        middle = np.flatnonzero(flat[2 : 2 + len(doc)] != 32) + 2  # trigrams around a letter
        gram = (flat[middle - 1].astype(np.uint32) << 16) | (flat[middle].astype(np.uint32) << 8) | flat[middle + 1]
        slot = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        counts = np.bincount(doc[middle - 2] * DIMS + slot, minlength=len(part) * DIMS)
        out[start:stop] = counts.reshape(len(part), DIMS)
        start = stop
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k distinct codewords: all splits of up to 7 languages, else the best of some random codes."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.float32)
    if k <= 7:
        splits = np.arange(1, 2 ** (k - 1))
        return np.where((splits[None, :] >> np.arange(k)[:, None]) & 1, 1, -1).astype(np.float32)
    bits, rng, best, far = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None, -1
    for _ in range(50):
        c = rng.choice(np.array([-1, 1], dtype=np.float32), size=(k, bits))
        apart = (bits - c @ c.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > far and (np.abs(c.sum(axis=0)) < k).all():
            best, far = c, apart.min()
    return best


def fit_bits(x: np.ndarray, langs: list[str], rounds: int = 200, decay: float = 1e-4) -> Model:
    """All binary classifiers at once, by accelerated gradient steps on the logistic loss."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    y = codes[np.searchsorted(names, langs)]
    w, b = np.zeros((DIMS, codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    vw, vb, step = w.copy(), b.copy(), 8.0  # rows have length 1, so the loss is 1/4-smooth or better
    for i in range(rounds if codes.shape[1] else 0):
        g = -y / (1 + np.exp(y * (x @ vw + vb))) / len(x)
        nw, nb = vw - step * (x.T @ g + decay * vw), vb - step * 0.25 * g.sum(axis=0)
        m = i / (i + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    right = ((x @ w + b) * y > 0).mean(axis=0) if len(x) else np.ones(codes.shape[1])
    trust = np.maximum(right - 0.5, 0.01)
    trust = trust / trust.sum() if trust.size else trust
    model = Model(tuple(names), codes, w.astype(np.float32), b.astype(np.float32), trust.astype(np.float32))
    return replace(model, bound=lead_bound(model, x, langs))


#: Of texts of two languages, the share that the bound is to flag, and the share of those of one language that it may; pairs of texts mixed for two languages.
MIXED, PURE, PAIRS = 0.95, 0.01, 50


def lead_bound(model: Model, x: np.ndarray, langs: list[str]) -> float:
    """The lead below which a text is ambiguous, learned from training texts and from their half-and-half mixtures; 0 with fewer than two languages."""
    by_lang = [x[np.asarray(langs) == g][:PAIRS] for g in model.langs]
    mixed = [np.sqrt((a[:n] ** 2 + b[:n] ** 2) / 2) for a, b in combinations(by_lang, 2) if (n := min(len(a), len(b)))]
    if not mixed:
        return 0.0
    of_two, of_one = decode(model, np.concatenate(mixed))[2], decode(model, x)[2]
    return float(min(np.quantile(of_two, MIXED), np.quantile(of_one, PURE)))


def _sample(known: DataFrame, per_lang: int, max_docs: int) -> DataFrame:
    """doc_id, lang and t (hash of a text) of ``max_docs`` documents at most, ``per_lang`` of a language: those of the least hashes of ids.

    Ids far above the sample are dropped where they are read, at a bound that
    follows each language's count, and a repeated id counts once, with the least
    hash of its texts. The bound widens until every language has its share.
    """
    spark, spread = known.sparkSession, 1 << 40
    known = known.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.pmod(F.xxhash64("doc_id"), F.lit(spread)).alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    reach = {g: min(spread, 1 + 2 * spread * per_lang // n) for g, n in counts.items()}
    schema = "lang string, reach long"
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    while True:
        bounds = F.broadcast(spark.createDataFrame(list(reach.items()), schema))  # a row a language
        near = known.join(bounds, "lang").filter("h < reach").groupBy("lang", "doc_id", "h").agg(F.min("t").alias("t"))
        found = near.withColumn("r", rank).filter(F.col("r") <= per_lang).collect()
        have = Counter(r["lang"] for r in found)
        few = [g for g in reach if have[g] < per_lang and reach[g] < spread]
        if not few:
            break
        reach |= {g: min(spread, 8 * reach[g]) for g in few}
    found = sorted(found, key=lambda r: (r["r"], r["h"], r["doc_id"], r["lang"]))[:max_docs]
    return spark.createDataFrame([(r["doc_id"], r["lang"], r["t"]) for r in found], "doc_id long, lang string, t long")


def fit(docs: DataFrame, per_lang: int = 400, max_docs: int = 2000) -> Model:
    """Learn from at most ``max_docs`` labelled documents, ``per_lang`` of a language.

    The sample is the ids with the smallest hashes among those whose crc32 isn't
    held out, each with one of its texts. Ids alone are gathered; whole texts are
    then turned into features on the executors, one row a sampled id.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(learnable("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = _sample(known, per_lang, max_docs)

    def sparse(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                part = pdf.iloc[lo : lo + ROWS]
                x = features(list(part["text"]))
                cells = [np.flatnonzero(row) for row in x]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "lang": part["lang"],
                    "cells": [c.astype("<u2").tobytes() for c in cells],
                    "values": [row[c].astype("<f4").tobytes() for row, c in zip(x, cells, strict=True)],
                })

    wanted = known.withColumn("t", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "lang", "t"])  # max_docs rows
    made = wanted.select("doc_id", "lang", "text").mapInPandas(sparse, "doc_id long, lang string, cells binary, values binary")
    rows = made.groupBy("doc_id", "lang").agg(F.min(F.struct("cells", "values")).alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["x"]["cells"], "<u2")] = np.frombuffer(r["x"]["values"], "<f4")
    return fit_bits(x, [r["lang"] for r in rows])


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's index, its share of belief, and its lead over the runner-up."""
    margins = x @ model.weights + model.bias
    plus, minus = np.logaddexp(0, -margins) * model.trust, np.logaddexp(0, margins) * model.trust
    up = (model.codes > 0).astype(np.float32)
    loss = plus @ up.T + minus @ (1 - up).T
    belief = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    belief /= belief.sum(axis=1, keepdims=True)
    ranked = np.sort(belief, axis=1)
    lead = ranked[:, -1] - (ranked[:, -2] if belief.shape[1] > 1 else 0)
    return belief.argmax(axis=1), ranked[:, -1], lead


def decode_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """decode for the features of whole texts, a few rows at a time."""
    parts = [decode(model, features(texts[i : i + ROWS])) for i in range(0, len(texts), ROWS)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identified(model: Model, ambiguous_below: float | None = None):
    """A column function of whole texts: a struct of lang_pred, score (0 to 1) and ambiguous (the best codeword's lead is below the model's bound, or the one given)."""
    bound = model.bound if ambiguous_below is None else ambiguous_below

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "ambiguous": False})
        rows = [i for i, t in enumerate(texts) if t is not None and model.langs and has_letter(t)]
        if rows:
            best, score, lead = decode_texts(model, [texts.iloc[i] for i in rows])
            out.loc[rows, "lang_pred"] = [model.langs[b] for b in best]
            out.loc[rows, "score"] = score.astype(float)
            out.loc[rows, "ambiguous"] = lead < bound
        return out

    return predict


def identify(docs: DataFrame, model: Model, ambiguous_below: float | None = None) -> DataFrame:
    """Add lang_pred, score and ambiguous to every row, instead of any columns so named."""
    small_batches(docs.sparkSession)
    found = docs.drop("lang_pred", "score", "ambiguous").withColumn("_lid", identified(model, ambiguous_below)("text"))
    return found.select("*", "_lid.*").drop("_lid")
