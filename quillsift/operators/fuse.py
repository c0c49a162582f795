"""Fusion of overlapping detections of a frame.

The order matters, and a base's box grows while it absorbs, so this is a fold
within each frame and not a closure. Frames are independent of one another.

Detections hang in grids, one of each scale, so that a base meets only those near
its box. What is near is taken in the order of the frame; as the box grows, it meets
the later ones of the cells it newly covers, and not those that have been passed.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.functions import entity

# Thresholds of what is one region.
OVERLAP, SLACK, LINE, LEFT, RIGHT, ADJACENT = 0.20, 5.0, 18.0, -6.0, 40.0, ("private_person", "private_address")
REGION = "type string, sources array<string>, confidence double, x0 double, y0 double, x1 double, y1 double, n_merged long"


def _touch(a: list[float], b: list[float], kind: str) -> bool:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w > 0 and h > 0:
        both = w * h
        if both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) > OVERLAP:
            return True
    for p, q in ((a, b), (b, a)):
        if q[0] >= p[0] - SLACK and q[1] >= p[1] - SLACK and q[2] <= p[2] + SLACK and q[3] <= p[3] + SLACK:
            return True
    level = abs(a[1] - b[1]) < LINE and abs(a[3] - b[3]) < LINE
    return kind in ADJACENT and level and (LEFT <= b[0] - a[2] <= RIGHT or LEFT <= a[0] - b[2] <= RIGHT)


def _compatible(a: str, sa: str, b: str, sb: str) -> bool:
    return a == b or {a, b} == {"secret", "token"} or (sa == "visual" and sb == "visual")


def fuse_rows(frame: pd.DataFrame) -> list[tuple]:
    """(type, sources, confidence, box, number merged) of regions in the order of their bases."""
    rows = frame.sort_values(["confidence", "arrival"], ascending=[False, True], kind="stable")
    return fold(list(zip(rows["type"], rows["source"], rows["confidence"], rows[["x0", "y0", "x1", "y1"]].to_numpy().tolist(), strict=True)))


#: How far apart two boxes can lie and still touch.
REACH = max(SLACK, LINE, RIGHT, -LEFT) + 1


class _Near:
    """The boxes of a frame by kind, scale and cell; a box lies in the one cell that holds its corner."""

    def __init__(self) -> None:
        self.cells: dict[tuple, list[int]] = {}
        self.scales: dict[str, dict[int, list[int]]] = {}
        self.odd: dict[str, list[int]] = {}

    @staticmethod
    def _hull(box: list[float]) -> tuple[float, float, float, float]:
        return min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])

    def add(self, kind: str, i: int, box: list[float]) -> None:
        if not all(map(math.isfinite, box)):
            self.odd.setdefault(kind, []).append(i)
            return
        x0, y0, x1, y1 = self._hull(box)
        scale = max(6, math.frexp(max(x1 - x0, y1 - y0))[1])  # 64 pixels, or the next power of two
        self.cells.setdefault((kind, scale, int(x0 // 2**scale), int(y0 // 2**scale)), []).append(i)
        self.scales.setdefault(kind, {}).setdefault(scale, []).append(i)

    def around(self, kind: str, box: list[float], first: int, used: list[bool]) -> list[int]:
        """All after ``first`` whose boxes may touch ``box`` and that aren't used, and some more. Others are forgotten, as bases only go on."""

        def kept(held: dict, key: object) -> list[int]:
            every = held.get(key)
            if not every:
                return []
            left = [j for j in every if j > first and not used[j]]
            if 2 * len(left) < len(every):
                held[key] = left
            return left

        found, scales = list(kept(self.odd, kind)), self.scales.get(kind, {})
        if not all(map(math.isfinite, box)):
            return found + [i for scale in scales for i in kept(scales, scale)]
        x0, y0, x1, y1 = self._hull(box)
        for scale, every in scales.items():
            size = 2**scale
            # a box of this scale that touches begins at most one cell before
            lo_x, hi_x = int((x0 - REACH) // size) - 1, int((x1 + REACH) // size)
            lo_y, hi_y = int((y0 - REACH) // size) - 1, int((y1 + REACH) // size)
            if (hi_x - lo_x + 1) * (hi_y - lo_y + 1) > len(every):
                found += kept(scales, scale)
                continue
            for x in range(lo_x, hi_x + 1):
                for y in range(lo_y, hi_y + 1):
                    found += kept(self.cells, (kind, scale, x, y))
        return found


def _kinds(kind: str, source: str) -> tuple[str, ...]:
    """Where a detection hangs, and where its partners do: with its type, and all visual ones with each other."""
    own = "secret" if kind == "token" else kind
    return (own, "\0visual") if source == "visual" else (own,)


def _region(kind: str, sources: list[str], confidence: float, box: list[float], n: int) -> tuple:
    return kind, sources, round(min(0.99, confidence + 0.02) if len(sources) > 1 else confidence, 2), *box, n


#: Detections of a frame that are compared with each other rather than hung in grids.
FEW = 16


def _fold_few(items: list[tuple]) -> list[tuple]:
    """``fold`` of few detections: every base meets all that come after it."""
    used, out = [False] * len(items), []
    for i, (base, source, confidence, at) in enumerate(items):
        if used[i]:
            continue
        kind, at, sources, n = base, list(at), [source], 1
        for j in range(i + 1, len(items)):
            k2, s2, c2, b2 = items[j]
            if not used[j] and _compatible(base, source, k2, s2) and _touch(at, b2, base):
                used[j], n = True, n + 1
                at = [min(at[0], b2[0]), min(at[1], b2[1]), max(at[2], b2[2]), max(at[3], b2[3])]
                sources += [s2] * (s2 not in sources)
                confidence = max(confidence, c2)
                kind = k2 if kind == "unknown" else kind
        out.append(_region(kind, sources, confidence, at, n))
    return out


def fold(items: list[tuple]) -> list[tuple]:
    """Regions of detections (type, source, confidence, box), the surest first.

    What may join a base is judged by the base's own type, even where the region
    has taken a more specific one from a member.
    """
    if len(items) <= FEW:
        return _fold_few(items)
    near = _Near()
    for i, (kind, source, _, box) in enumerate(items):
        for k in _kinds(kind, source):
            near.add(k, i, box)
    used, out = [False] * len(items), []
    for i, (base, source, confidence, at) in enumerate(items):
        if used[i]:
            continue
        kind, at, sources, n = base, list(at), [source], 1
        met: set[int] = set()
        ahead: list[int] = []

        def look(last: int) -> None:
            for k in _kinds(base, source):
                for j in near.around(k, at, i, used):
                    if j > last and j not in met:
                        met.add(j)
                        heapq.heappush(ahead, j)

        look(i)
        while ahead:
            j = heapq.heappop(ahead)
            k2, s2, c2, b2 = items[j]
            if _compatible(base, source, k2, s2) and _touch(at, b2, base):
                used[j], n = True, n + 1
                grown = [min(at[0], b2[0]), min(at[1], b2[1]), max(at[2], b2[2]), max(at[3], b2[3])]
                sources += [s2] * (s2 not in sources)
                confidence = max(confidence, c2)
                kind = k2 if kind == "unknown" else kind
                if grown != at:
                    at = grown
                    look(j)
        out.append(_region(kind, sources, confidence, at, n))
    return out


#: The order of detections of equal confidence: by source, then as each source found them.
SOURCES = ("privacy_filter", "rule", "visual")


def arrived(detections: DataFrame, *order: str) -> DataFrame:
    """Add ``arrival``, the place of each detection in its frame: by source, then by ``order``."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return detections.withColumn("arrival", F.row_number().over(Window.partitionBy("doc_id").orderBy(place, *order)).cast("long"))


def frames(detections: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, cells): the detections (arrival, type, source, confidence, x0..y1) of each frame as they are folded, the surest first; with columns to keep."""
    cell = F.struct((-F.col("confidence")).alias("_o"), "arrival", "type", "source", "confidence", "x0", "y0", "x1", "y1", *keep)
    return detections.groupBy("doc_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def regions(cells: Column, policy: dict[str, str] | None = None) -> Column:
    """The fused regions of frames, each with tag, risk, token, action and detail, in the order of risk and place."""
    fields = [f.split()[0] for f in REGION.split(", ")]

    @F.arrow_udf(f"array<struct<{REGION.replace(' ', ': ')}>>".replace(",: ", ", "))
    def folded(frames: pa.Array) -> pa.Array:
        flat, sizes = frames.flatten(), frames.value_lengths().fill_null(0).to_pylist()
        kind, source, sure, *box = (flat.field(k).to_pylist() for k in ("type", "source", "confidence", "x0", "y0", "x1", "y1"))
        items, at, out, ends = list(zip(kind, source, sure, map(list, zip(*box, strict=True)), strict=True)), 0, [], [0]
        for n in sizes:
            out += fold(items[at : at + n])
            at += n
            ends.append(len(out))
        cols = list(zip(*out, strict=True)) if out else [()] * len(fields)
        kinds = (pa.string(), pa.list_(pa.string()), *[pa.float64()] * 5, pa.int64())
        made = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=fields)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    def told(r: Column, i: Column) -> Column:
        seq, kind = (i + 1).cast("long"), r["type"]
        level, tag = entity.risk(kind), entity.tag(kind)
        return F.struct(
            entity.rank(level).alias("_k"), r["y0"].alias("_y"), seq.alias("seq"), *(r[f].alias(f) for f in fields), tag.alias("tag"), level.alias("risk"),
            F.concat(F.lit("fused-"), seq).alias("id"), F.concat(F.lit("<"), tag, F.lit("_0"), seq, F.lit(">")).alias("token"),
            entity.action(level, policy).alias("action"), entity.source_detail(kind, r["sources"]).alias("detail"),
        )

    return F.transform(F.array_sort(F.transform(folded(cells), told)), lambda r: r.dropFields("_k", "_y"))


def fuse(detections: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """Fused regions of detections (doc_id, arrival, type, source, confidence, x0..y1), with tag, risk, token, action and rank."""
    found = frames(detections).select("doc_id", regions(F.col("cells"), policy).alias("rs"))
    return found.select("doc_id", F.posexplode("rs").alias("place", "r")).select("doc_id", "r.*", (F.col("place") + 1).cast("long").alias("place"))
