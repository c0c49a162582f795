"""Pixel operators: brightness, contrast, skin and dark masks, connected components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def luma() -> Column:
    r, g, b = _rgb()
    return 0.299 * r + 0.587 * g + 0.114 * b


def dark_mode(pixels: DataFrame) -> DataFrame:
    """(frame_id, mean, dark): mean brightness of every fourth pixel; dark below 130."""
    out = pixels.filter(F.pmod("pos", F.lit(4)) == 0).groupBy("frame_id").agg(F.round(F.avg(luma()), 6).alias("mean"))
    return out.withColumn("dark", F.col("mean") < 130)


def stretch(gray: Column) -> Column:
    """Contrast: above 210 white, below 50 black, in between spread over the range."""
    return F.when(gray > 210, 255.0).when(gray < 50, 0.0).otherwise((gray - 50) * 255 / 160)


# Fixed values of the next two: ranges of skin and dark pixels. They take Columns as well as arrays of numbers.
def skin_of(r, g, b):
    y, cb, cr = 0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    white = (r > 225) & (g > 218) & (b > 210)
    ranges = (y >= 35) & (y <= 225) & (cr >= 133) & (cr <= 178) & (cb >= 80) & (cb <= 130)
    return ~white & ranges & (cr > cb + 10) & (r > g) & (r > b) & (r - g >= 10)


def dark_of(r, g, b):
    return (r < 70) & (g < 70) & (b < 70)


def is_skin() -> Column:
    return skin_of(*_rgb())


def is_dark() -> Column:
    return dark_of(*_rgb())


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and column after the last of each run of marked cells, row by row."""
    edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edge == 1)
    return rows, first, np.nonzero(edge == -1)[1]


def blobs(grid: np.ndarray, seed: int, grow: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row0, col0, row1, col1, cells, sum) of 8-connected groups of cells >= grow that hold one >= seed, by their last cells.

    Runs of cells are joined with those of the row before that they touch.
    """
    rows, first, last = runs(grid >= grow)
    if not len(rows):
        return []
    upto = lambda a: np.concatenate([np.zeros((len(a), 1), dtype=np.int64), np.cumsum(a, axis=1, dtype=np.int64)], axis=1)
    sums, seeds = (c[rows, last] - c[rows, first] for c in (upto(grid), upto(grid >= seed)))
    held = list(zip(rows.tolist(), first.tolist(), last.tolist(), sums.tolist(), seeds.tolist(), strict=True))
    root = list(range(len(held)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    j = 0
    for i, (row, a, b, _, _) in enumerate(held):
        while held[j][0] < row - 1 or (held[j][0] == row - 1 and held[j][2] < a):
            j += 1
        k = j
        while held[k][0] == row - 1 and held[k][1] <= b:
            root[top(k)] = top(i)
            k += 1
    found: dict[int, list[int]] = {}
    for i, (row, a, b, n, seen) in enumerate(held):
        g = found.setdefault(top(i), [row, a, row, b - 1, 0, 0, 0, 0])
        g[1], g[2], g[3] = min(g[1], a), row, max(g[3], b - 1)
        g[4], g[5], g[6], g[7] = g[4] + b - a, g[5] + n, g[6] + seen, row * grid.shape[1] + b
    return [tuple(g[:6]) for g in sorted(found.values(), key=lambda g: g[7]) if g[6]]


def components(cells: DataFrame, seed: int, grow: int) -> DataFrame:
    """Blobs of each frame from cell counts (frame_id, row, col, n), best sum first, first found on ties."""
    schema = "frame_id long, row0 long, col0 long, row1 long, col1 long, n_cells long, score long"

    def of_frame(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), dtype=np.int64)
        grid[pdf["row"], pdf["col"]] = pdf["n"]
        found = sorted(blobs(grid, seed, grow), key=lambda b: (-b[5], b[0], b[1]))
        return pd.DataFrame([(key[0], *b) for b in found], columns=[c.split()[0] for c in schema.split(", ")])

    return cells.groupBy("frame_id").applyInPandas(of_frame, schema)


# Preprocessing before text is read.
GROW_BELOW, GROW_BY, WIDEST = (1400, 1000), 1.5, 2600


def scan_scale(width: Column, height: Column) -> Column:
    """By how much a frame is enlarged before its text is read: small ones are, none beyond the widest."""
    grown = F.when((width < GROW_BELOW[0]) | (height < GROW_BELOW[1]), F.lit(GROW_BY)).otherwise(F.lit(1.0))
    return F.when(width * grown > WIDEST, F.lit(float(WIDEST)) / width).otherwise(grown)


def preprocess(pixels: DataFrame) -> DataFrame:
    """Add ``v``: gray with stretched contrast, of inverted colours in dark frames."""
    dark = dark_mode(pixels).select("frame_id", "dark")
    gray = F.when(F.col("dark"), 255 - luma()).otherwise(luma())
    return pixels.join(dark, "frame_id", "left").withColumn("v", stretch(gray)).drop("dark")


# Fixed values. A zone is left, top, width and height as shares of the frame's; the first zone with a face ends the search.
FACE_ZONES = ((0.45, 0.03, 0.53, 0.65), (0.01, 0.04, 0.50, 0.78), (0.15, 0.04, 0.70, 0.75))
FACE = {"cell": 6, "seed": 2, "grow": 1, "least_zone": (45, 50), "least_size": (20, 24), "least_sum": 15, "pad": (0.18, 0.35, 0.25),
        "box": (35, 45), "most": ((300, 0.65), (380, 0.75)), "aspect": (0.45, 1.35), "word_length": 3, "words": 4, "confidence": 0.98}
CODE_ZONE = (0.02, 0.40, 0.45, 0.58)
CODE = {"cell": 8, "seed": 12, "grow": 10, "box": (45, 200), "aspect": (0.82, 1.20), "cells": 20, "pad": 4, "word_length": 4, "words": 2, "confidence": 0.97}


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _grid(at: np.ndarray, zone: tuple[int, int, int, int], cell: int) -> np.ndarray:
    """Marked pixels of a zone, counted by whole cells: pixels (x, y), or rectangles of them (x0, y0, x1, y1) that don't overlap."""
    left, top, width, height = zone
    rows, cols = height // cell, width // cell
    if at.shape[1] == 4 and rows and cols:
        shared = lambda a, b, n: np.clip(np.minimum(b[:, None], (np.arange(n) + 1) * cell) - np.maximum(a[:, None], np.arange(n) * cell), 0, None)
        return shared(at[:, 1] - top, at[:, 3] - top, rows).T @ shared(at[:, 0] - left, at[:, 2] - left, cols)
    x, y = (at[:, 0] - left) // cell, (at[:, 1] - top) // cell
    inside = (at[:, 0] >= left) & (at[:, 1] >= top) & (x < cols) & (y < rows)
    return np.bincount(y[inside] * cols + x[inside], minlength=rows * cols).reshape(rows, cols) if rows and cols else np.zeros((0, 0), dtype=np.int64)


def _words_inside(words: np.ndarray, box: tuple, length: int) -> int:
    """words: rows of x, y of the middle and the number of letters and digits."""
    if not len(words):
        return 0
    x, y, n = words.T
    return int(((n >= length) & (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])).sum())


def _zone(share: tuple, width: int, height: int) -> tuple[int, int, int, int]:
    return tuple(_half_up(s * n) for s, n in zip(share, (width, height, width, height), strict=True))


def face_box(skin: np.ndarray, zone: tuple, width: int, height: int, words: np.ndarray) -> tuple | None:
    """The box of the group with most skin that has the shape of a portrait and holds no paragraph."""
    left, top, w, h = zone
    if w < FACE["least_zone"][0] or h < FACE["least_zone"][1]:
        return None
    cell, best, most = FACE["cell"], None, 0
    for r0, c0, r1, c1, _, n in blobs(_grid(skin, zone, cell), FACE["seed"], FACE["grow"]):
        bw, bh = (c1 - c0 + 1) * cell, (r1 - r0 + 1) * cell
        if bw < FACE["least_size"][0] or bh < FACE["least_size"][1] or n < FACE["least_sum"]:
            continue
        side, up, down = _half_up(bw * FACE["pad"][0]), _half_up(bh * FACE["pad"][1]), _half_up(bh * FACE["pad"][2])
        box = (
            max(0, c0 * cell - side + left), max(0, r0 * cell - up + top),
            min(width, (c1 + 1) * cell + side + left), min(height, (r1 + 1) * cell + down + top),
        )
        size = (box[2] - box[0], box[3] - box[1])
        limits = [max(least, share * n_) for (least, share), n_ in zip(FACE["most"], (width, height), strict=True)]
        aspect = size[0] / max(1, size[1])
        fits = all(lo <= x <= hi for lo, x, hi in zip(FACE["box"], size, limits, strict=True)) and FACE["aspect"][0] <= aspect <= FACE["aspect"][1]
        if fits and n > most and _words_inside(words, box, FACE["word_length"]) < FACE["words"]:
            best, most = box, n
    return best


def code_boxes(dark: np.ndarray, width: int, height: int, words: np.ndarray) -> list[tuple]:
    """Square groups of dense dark cells in the zone of codes that hold no text."""
    zone, cell, out = _zone(CODE_ZONE, width, height), CODE["cell"], []
    for r0, c0, r1, c1, n_cells, _ in blobs(_grid(dark, zone, cell), CODE["seed"], CODE["grow"]):
        bw, bh = (c1 - c0 + 1) * cell, (r1 - r0 + 1) * cell
        lo, hi = CODE["box"]
        if lo <= bw <= hi and lo <= bh <= hi and CODE["aspect"][0] <= bw / max(1, bh) <= CODE["aspect"][1] and n_cells >= CODE["cells"]:
            pad = CODE["pad"]
            box = (
                max(0, c0 * cell - pad + zone[0]), max(0, r0 * cell - pad + zone[1]),
                min(width, (c1 + 1) * cell + pad + zone[0]), min(height, (r1 + 1) * cell + pad + zone[1]),
            )
            if _words_inside(words, box, CODE["word_length"]) < CODE["words"]:
                out.append(box)
    return out


VISUAL = "doc_id long, type string, confidence double, x0 double, y0 double, x1 double, y1 double"


def hits_of_frame(doc_id: int, skin: np.ndarray, dark: np.ndarray, width: int, height: int, words: np.ndarray) -> list[tuple]:
    """Rows of ``VISUAL``: the first face and all codes, from marked pixels (x, y) or rectangles of them and words (x, y of the middle, letters and digits)."""
    faces = (face_box(skin, _zone(z, width, height), width, height, words) for z in FACE_ZONES)
    face = next((f for f in faces if f), None)
    rows = [(doc_id, "face", FACE["confidence"], *map(float, face))] if face else []
    return rows + [(doc_id, "qr_code", CODE["confidence"], *map(float, b)) for b in code_boxes(dark, width, height, words)]


def middles(boxed: DataFrame) -> DataFrame:
    """(doc_id, x, y, n): the middle of each word and its number of letters and digits."""
    n = F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]", ""))
    return boxed.select("doc_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), n.alias("n"))


def visual(pixels: DataFrame, frames: DataFrame, boxed: DataFrame) -> DataFrame:
    """Faces and codes of frames (doc_id, width, height), from pixels (doc_id, x, y, r, g, b) and words (doc_id, word, x0..y1).

    Only skin and dark pixels are moved, frame by frame; ``tiles.visual`` moves them as bits.
    """
    marked = pixels.select("doc_id", "x", "y", is_skin().alias("skin"), is_dark().alias("dark")).filter("skin OR dark")
    named = frames.select(F.col("doc_id").alias("_f"), "width", "height")
    marked = marked.join(named, F.col("doc_id") == F.col("_f")).drop("_f")

    def of_frame(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(left):
            words = right[["x", "y", "n"]].to_numpy(dtype=float)
            at = left[["x", "y"]].to_numpy(dtype=np.int64)
            rows = hits_of_frame(key[0], at[left["skin"].to_numpy()], at[left["dark"].to_numpy()], int(left["width"].iat[0]), int(left["height"].iat[0]), words)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in VISUAL.split(", ")])

    return marked.groupBy("doc_id").cogroup(middles(boxed).groupBy("doc_id")).applyInPandas(of_frame, VISUAL)
