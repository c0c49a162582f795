"""Words with boxes of a text reader: grouping into lines, and detection on them.

Words are put in reading order by a comparison that isn't transitive: two whose upper
edges lie over 12 pixels apart go by height, others from left to right. What order
slanted or overlapping words get therefore depends on how they are sorted. They are
taken in the order in which the reader gave them: a first run that rises or falls
stands, and each later word is put in its place by halving. So it is done once for
each frame, and results depend neither on how a cluster deals rows out nor on any
library's sort. A line goes on as long as the middles of its words lie
within 15 pixels of that of its first word.

Defined results: words without a frame or a box are left out; a frame without words
has no lines. Words given twice stay twice. A frame is worked on whole, in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.operators import detect

# Heights that differ by more than ROW order words; middles within BAND share a line.
ROW, BAND = 12, 15
BOX = ("x0", "y0", "x1", "y1")


def _before(a: tuple, b: tuple) -> float:
    down = a[1] - b[1]
    return down if abs(down) > ROW else a[0] - b[0]


def reading_order(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Places of boxes in reading order."""
    order = list(range(len(boxes)))
    run = min(2, len(order))
    if run == 2:
        falls = _before(boxes[1], boxes[0]) < 0
        while run < len(order) and (_before(boxes[run], boxes[run - 1]) < 0) == falls:
            run += 1
        if falls:
            order[:run] = order[:run][::-1]
    for k in range(run, len(order)):
        lo, hi = 0, k
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _before(boxes[k], boxes[order[mid]]) < 0 else (mid + 1, hi)
        order.insert(lo, order.pop(k))
    return order


def lines_of(boxes: Iterable[tuple[float, float, float, float]]) -> list[list[int]]:
    """Places of boxes (x0, y0, x1, y1), line by line."""
    held = list(boxes)
    out: list[list[int]] = []
    level = 0.0
    for i in reading_order(held):
        middle = (held[i][1] + held[i][3]) / 2
        if out and abs(middle - level) <= BAND:
            out[-1].append(i)
        else:
            out.append([i])
            level = middle
    return out


def group_lines(words: DataFrame, order: str = "seq") -> DataFrame:
    """(doc_id, ln, wi, word, x0..y1) of words (doc_id, word, x0..y1) of frames, given in ``order``."""
    held = words.select("doc_id", F.col(order).alias("_order"), "word", *(F.col(c).cast("double").alias(c) for c in BOX)).dropna(subset=["doc_id", "word", *BOX])
    dealt = held.repartition("doc_id").sortWithinPartitions("doc_id", "_order", *BOX, "word")
    kind = held.schema["doc_id"].dataType.simpleString()

    def grouped(frame: list[tuple]) -> Iterator[tuple]:
        for ln, line in enumerate(lines_of(r[2:] for r in frame)):
            for wi, i in enumerate(line):
                yield frame[i][0], ln, wi, *frame[i][1:]

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["doc_id", "ln", "wi", "word", *BOX]
        frame: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf[["doc_id", "word", *BOX]].itertuples(index=False, name=None):
                if frame and frame[0][0] != r[0]:
                    out += grouped(frame)
                    frame = []
                frame.append(r)
            yield pd.DataFrame(out, columns=cols)
        yield pd.DataFrame(list(grouped(frame)), columns=cols)

    return dealt.mapInPandas(streamed, f"doc_id {kind}, ln long, wi long, word string, x0 double, y0 double, x1 double, y1 double")


def lined(words: DataFrame) -> DataFrame:
    """(doc_id, ln, line, ws) of grouped words, for the detectors that read lines."""
    ws = F.transform(F.array_sort(F.collect_list(F.struct("wi", "word"))), lambda c: c["word"])
    return words.groupBy("doc_id", "ln").agg(ws.alias("ws")).withColumn("line", F.array_join("ws", " "))


def hit_boxes(hits: DataFrame, words: DataFrame) -> DataFrame:
    """Add the boxes of the first to the last word of each hit (doc_id, ln, wi, wi_to)."""
    each = hits.select("*", F.explode(F.sequence("wi", "wi_to")).alias("_w"))
    met = each.join(words.select("doc_id", "ln", F.col("wi").alias("_w"), *BOX).hint("merge"), ["doc_id", "ln", "_w"])
    return met.groupBy(*hits.columns).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def detect_words(words: DataFrame, unicode_labels: bool = False) -> DataFrame:
    """(detector, doc_id, ln, wi, wi_to, type, confidence, text, x0..y1): hits of the word detectors, and of values below labels, on grouped words."""
    simple = tuple(n for n in detect.ORDER if n not in ("email_joined", "address"))
    read = lined(words)
    hits = detect.detect_many(read, simple, unicode_labels).unionByName(detect.detect_email_joined(read).withColumn("detector", F.lit("email_joined")))
    return detect.with_below(hit_boxes(hits, words), words)
