"""Sketches, which hold rectangles only, against tiles of pixels; groups of cells against flooding."""

import random

import numpy as np

from quillsift.operators import detect, pixels, tiles
from quillsift.plans import catalog
from quillsift.sources import tables

RECT = "doc_id long, x0 long, y0 long, x1 long, y1 long, colour int, z long"
COLOURS = {"paper": tiles.PAPER, "skin": 0xC88C6E, "dark": 0x101010, "mask": tiles.MASK}


def drawings(spark):
    rng, rects = random.Random(5), []
    sizes = {1: (640, 480), 2: (300, 200), 3: (65, 64), 4: (1, 129), 5: (0, 10), 6: (640, 480), 7: (640, 480)}
    for d, (w, h) in sizes.items():
        for z in range(12 if d < 6 else 0):
            x, y = sorted(rng.randint(0, w + 9) for _ in range(2)), sorted(rng.randint(0, h + 9) for _ in range(2))
            rects.append((d, x[0], y[0], x[1], y[1], rng.choice(list(COLOURS.values())), z))
    rects += [(7, 438, 32, 534, 152, 0xC88C6E, 0), (7, 29, 328, 109, 408, 0x101010, 0), (7, 50, 340, 60, 345, 0x777777, 1), (8, 0, 0, 9, 9, 0, 0)]
    frames = spark.createDataFrame([(d, *s) for d, s in sizes.items()], "doc_id long, width long, height long")
    return frames, spark.createDataFrame(rects * 2, RECT)


def test_sketches_count_and_find_as_tiles_do(spark):
    frames, rects = drawings(spark)
    words = spark.createDataFrame([(1, "word", 40.0, 340.0, 60.0, 352.0), (7, "more", 40.0, 360.0, 60.0, 372.0)], "doc_id long, word string, x0 double, y0 double, x1 double, y1 double")
    painted = tiles.fill(tiles.blank(frames), rects)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for side in (tiles.WIDE, 100):
        sketched = tiles.sketch(frames, rects, side)
        assert rows(tiles.sketched_colours(sketched, **COLOURS)) == rows(tiles.count_colours(painted, **COLOURS))
        found = rows(tiles.sketched_visual(sketched, frames, words, side))
        assert found == rows(tiles.visual(painted, frames, words)) and [r[:2] for r in found if r[0] == 7] == [(7, "face"), (7, "qr_code")]
    none = tiles.sketch(frames.filter("false"), rects)
    assert none.count() == 0 and tiles.sketched_visual(none, frames, words).count() == 0
    assert {r.paper for r in tiles.sketched_colours(tiles.sketch(frames, rects.filter("false")), **COLOURS).collect()} == {640 * 480, 300 * 200, 65 * 64, 129}


def test_no_pixels_are_moved(spark, tmp_path):
    spark.range(20).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("visual_detections", "masked_pixels"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "rgb" not in plan, name


def flooded(grid, seed, grow):
    left, out = {(int(r), int(c)) for r, c in zip(*np.nonzero(grid >= grow), strict=True)}, []
    while left:
        held, edge = set(), [left.pop()]
        while edge:
            r, c = edge.pop()
            held.add((r, c))
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            edge += near
        if max(grid[p] for p in held) >= seed:
            rows, cols = zip(*held, strict=True)
            out.append((max(held), (min(rows), min(cols), max(rows), max(cols), len(held), int(sum(grid[p] for p in held)))))
    return [b for _, b in sorted(out)]


def test_groups_of_cells_equal_flooding():
    rng = np.random.default_rng(4)
    for _ in range(300):
        grid = rng.integers(0, 5, size=rng.integers(0, 14, size=2))
        for seed, grow in ((2, 1), (4, 3), (4, 4)):
            assert pixels.blobs(grid, seed, grow) == flooded(grid, seed, grow)


def test_rectangles_fill_cells_as_their_pixels_do():
    rng = random.Random(2)
    for _ in range(50):
        x, y = (sorted(rng.sample(range(60), 2)) for _ in range(2))
        rects = np.array([(x[0], y[0], x[1], y[1]), (70, 3, 75, 50)])
        points = np.array([(a, b) for x0, y0, x1, y1 in rects.tolist() for a in range(x0, x1) for b in range(y0, y1)])
        zone = (rng.randint(0, 20), rng.randint(0, 20), rng.randint(0, 70), rng.randint(0, 50))
        assert (pixels._grid(rects, zone, 6) == pixels._grid(points, zone, 6)).all()


def test_boxes_are_made_once_and_rules_tried_on_few_words(spark):
    """Spark puts what a plain posexplode reads into a filter below it too, which made the boxes anew."""
    lined = tables.lines(spark.createDataFrame([(1, "Name : ASHA\n\nPAN : ABCDE1234F"), (2, "")], "doc_id long, text string"))
    found, boxed = detect.detect_many(lined, ("pan", "names")), tables.word_boxes(lined)
    filters = lambda df: [x.lower() for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not any("size(" in x for x in filters(boxed)) and any("rlike(word" in x for x in filters(found))
    assert found.count() == 2 and boxed.count() == 6


def test_words_that_a_rule_hits_meet_what_it_asks_of_them(spark):
    text = "Name : श्री ASHA @x\nRegistration No : ABCDEFGH\nRoll No : 12345678\nAPI Token : abcdefghijklmnopq eyJa.b\nmail a@b.co +91 9876543210 2345, 6789, 0123."
    lined = tables.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    every = tuple(detect.rules())
    alone = {(n, r.ln, r.wi, r.wi_to) for n in every for r in detect.detect(lined, n).collect()}
    assert alone == {(r.detector, r.ln, r.wi, r.wi_to) for r in detect.detect_many(lined, every).collect()} and len(alone) >= 8
