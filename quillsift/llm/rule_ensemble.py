"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

Small trees are boosted on statistics of labelled texts; every path from a root
is a conjunctive rule. A logistic model with an L1 penalty weighs the rules and
the scaled statistics, which leaves most at zero. The rest is compiled into one
Spark column expression, so that scoring needs no Python.

Labels are learned from a bounded sample of labelled rows (``max_rows``, by the
hash of their ids); statistics of texts cover whole texts of all rows.

Defined results: a null or empty text has zero statistics and is scored like any
other; without labelled rows of both kinds every score is the share of ones (0.5
without any). A document counts once for each label that it has, however often
either is repeated; of texts that share an id, the one of the least statistics is
learned from. Rows that repeat a doc_id are scored each on its own. Columns named
like the results are replaced. An empty table has an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import learnable, materialize

SPACE = r"[\x20\x09-\x0D]+"


#: Characters of which a text is rid before marks, digits and capitals are counted in what is left.
PLAIN = "abcdefghijklmnopqrstuvwxyz "
#: Statistics by name, over the columns of ``parts``.
NAMES = (
    "n_words", "word_length", "distinct_words", "distinct_sentences", "distinct_lines", "words_per_line", "words_per_sentence",
    "symbols", "bars", "shouts", "stops", "commas", "digits", "capitals",
)


def parts(docs: DataFrame, *keep: str) -> DataFrame:
    """One pass over each whole text: its length, words, lines, sentences, and what is neither a small letter nor a blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    return docs.select(
        *keep, F.length(text).alias("_chars"), words.alias("_words"), F.split(text, "\n").alias("_lines"),
        F.split(text, r"[.!?]+").alias("_marks"), F.translate(text, PLAIN, "").alias("_rest"),
    )


def statistics(cut: DataFrame, *keep: str) -> DataFrame:
    """The statistics of the texts whose ``parts`` are given."""
    n, chars, lines, marks, rest = F.size("_words"), F.col("_chars"), F.size("_lines"), F.size("_marks"), F.col("_rest")
    per_word, per_char = F.greatest(n, F.lit(1)), F.greatest(chars, F.lit(1))
    held = lambda chars_: (F.length(rest) - F.length(F.translate(rest, chars_, ""))).cast("double")
    made = (
        n.cast("double"), chars / per_word, F.size(F.array_distinct("_words")) / per_word, F.size(F.array_distinct("_marks")) / marks,
        F.size(F.array_distinct("_lines")) / lines, n / lines, n / marks,
        held("#*$%&<>") / per_word, held("|") / per_word, held("!?") / per_word, held(".") / per_word, held(",;:") / per_word,
        held("0123456789") / per_char, held("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / per_char,
    )
    return cut.select(*keep, *(c.alias(k) for k, c in zip(NAMES, made, strict=True)))


@dataclass(frozen=True)
class Rules:
    """score = sigmoid(bias + sum of weights of the rules that hold + slopes of clipped statistics)."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...]
    slopes: tuple[tuple[float, str, float, float], ...]

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(self.bias)
        for weight, parts in self.rules:
            holds = F.lit(True)
            for name, sign, cut in parts:
                holds = holds & ((F.col(name) <= cut) if sign == "<=" else (F.col(name) > cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        for slope, name, lo, hi in self.slopes:
            total = total + F.lit(slope) * F.least(F.greatest(F.col(name), F.lit(lo)), F.lit(hi))
        return 1 / (1 + F.exp(-total))


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> None:
    """Split by the greatest gain; gather (path, rows) of every node below the root, the last ones as leaves."""
    best = None
    if depth and len(rows) >= 20:
        g, h, parent = grad[rows], hess[rows], grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
        for f in range(bins.shape[1]):
            gs, hs = np.bincount(bins[rows, f], g, 64).cumsum(), np.bincount(bins[rows, f], h, 64).cumsum()
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - parent
            k = int(gain[:-1].argmax())
            if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k)
    if best is None:
        out.append((path, rows, True))
        return
    if path:
        out.append((path, rows, False))
    _, f, k = best
    left = bins[rows, f] <= k
    _grow(bins, grad, hess, rows[left], depth - 1, (*path, (f, "<=", k)), out)
    _grow(bins, grad, hess, rows[~left], depth - 1, (*path, (f, ">", k)), out)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the bias is free."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    v = np.random.default_rng(0).random(x1.shape[1])
    for _ in range(20):
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(x) / np.linalg.norm(x1 @ v) ** 2
    w = np.zeros(x1.shape[1])
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        g = x1.T @ (1 / (1 + np.exp(-(x1 @ z))) - y) / len(x)
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def learn(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 25, depth: int = 3, penalty: float = 2e-3) -> Rules:
    """Rules from rows of statistics and their 0/1 labels."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Rules(float(np.log(share / (1 - share))), (), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 64)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    raw, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        nodes: list = []
        _grow(bins, y - p, p * (1 - p), np.arange(len(y)), depth, (), nodes)
        for path, rows, leaf in nodes:
            if path:
                found.setdefault(path, rows)
            if leaf:
                raw[rows] += 0.3 * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1)
    paths = sorted(found)
    rules = np.zeros((len(y), len(paths)))
    for j, path in enumerate(paths):
        rules[found[path], j] = 1
    lo, hi = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, lo, hi)
    scale = np.where(clipped.std(axis=0) > 1e-9, 0.4 / np.maximum(clipped.std(axis=0), 1e-9), 0)
    centre = clipped.mean(axis=0)
    bias, w = _lasso(np.hstack([rules, (clipped - centre) * scale]), y, penalty)
    kept = tuple((float(w[j]), tuple((names[f], sign, float(cuts[f][k])) for f, sign, k in paths[j])) for j in range(len(paths)) if w[j])
    slope = w[len(paths) :] * scale
    slopes = tuple((float(slope[f]), names[f], float(lo[f]), float(hi[f])) for f in range(len(names)) if slope[f])
    return Rules(bias - float((slope * centre).sum()), kept, slopes)


def fit(stats: DataFrame, labels: DataFrame, names: list[str], max_rows: int = 20000) -> Rules:
    """Learn from ``labels`` (doc_id, quality) of rows that aren't held out; at most ``max_rows`` rows of numbers are gathered.

    The sample is the rows of the least hashes of ids, one row for each id and label,
    so that an id that repeats takes one place. Hashes far above it are dropped where
    the labels are read, as every task would otherwise send its own ``max_rows``
    least rows to the driver.
    """
    spread = 1 << 30
    known = labels.filter(learnable("doc_id") & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("_y")).distinct()
    known = known.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    reach = min(spread, 1 + 5 * spread * max_rows // (4 * max(1, known.count())))  # a quarter more than are wanted
    rows = (
        stats.select("doc_id", *names).join(known.filter(F.col("_h") < reach), "doc_id")
        .groupBy("_h", "doc_id", "_y").agg(F.min(F.struct(*names)).alias("s"))
        .orderBy("_h", "doc_id", "_y").limit(max_rows).select("_y", "s.*").collect()
    )
    data = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(names) + 1)
    return learn(data[:, 1:], (data[:, 0] > 0).astype(float), names)


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 20000, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of ``docs``."""
    stats = materialize(statistics(parts(docs, "doc_id"), "doc_id"))
    rules = fit(stats, labels, list(NAMES), max_rows)
    scored = stats.withColumn("score", rules.column())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "score", "predicted")
