"""Fusion by grids, alignment by a trie, masks, line grouping and pages, against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillsift.operators import detect, fuse, names, ocr, redact, sanitize
from quillsift.sources import html, tables


def plain_fold(items):
    """Every base against all that follow, in order."""
    used, out = [False] * len(items), []
    for i, (base, source, confidence, at) in enumerate(items):
        if used[i]:
            continue
        kind, at, sources, n = base, list(at), [source], 1
        for j in range(i + 1, len(items)):
            k2, s2, c2, b2 = items[j]
            if not used[j] and fuse._compatible(base, source, k2, s2) and fuse._touch(at, b2, base):
                used[j], n = True, n + 1
                at = [min(at[0], b2[0]), min(at[1], b2[1]), max(at[2], b2[2]), max(at[3], b2[3])]
                sources += [s2] * (s2 not in sources)
                confidence = max(confidence, c2)
                kind = k2 if kind == "unknown" else kind
        out.append((kind, sources, round(min(0.99, confidence + 0.02) if len(sources) > 1 else confidence, 2), *at, n))
    return out


def frame(rng, n, span):
    rows = []
    for _ in range(n):
        x, y = rng.uniform(-span / 4, span), rng.choice([rng.uniform(0, span), 20.0 * rng.randrange(1 + span // 20)])
        w, h = rng.choice([(rng.uniform(0, 90), 12.0), (rng.uniform(0, 60), rng.uniform(0, 60)), (rng.uniform(0, span), rng.uniform(0, span))])
        odd = rng.random()
        x, w = (float("nan") if odd < 0.01 else float("inf") if odd < 0.02 else x), (-w if odd > 0.98 else w)
        kind = rng.choice(["private_person", "private_address", "secret", "token", "pan", "unknown", "face"])
        rows.append((kind, rng.choice(["rule", "privacy_filter", "visual"]), rng.choice([0.9, 0.95, 0.98]), [x, y, x + w, y + h]))
    return sorted(rows, key=lambda r: -r[2])


def test_grid_fold_equals_plain_fold():
    rng = random.Random(5)
    for _ in range(500):
        items = frame(rng, rng.randrange(0, 60), rng.choice([50, 200, 800]))
        assert str(fuse.fold(items)) == str(plain_fold(items))


def test_fifty_thousand_detections():
    items = [(("private_person", "pan", "secret")[i % 3], "rule", 0.98, [200.0 * (i % 10), 20.0 * (i // 10), 200.0 * (i % 10) + 50, 20.0 * (i // 10) + 12]) for i in range(50_000)]
    began = time.process_time()
    assert len(fuse.fold(items)) == 50_000
    assert time.process_time() - began < 10


def plain_places(words, spans):
    """Every span at every word, and the words that hold it where it is nowhere."""
    plain = [names._clean(w) for w in words]
    out = []
    for text in spans:
        tokens = [t for t in map(names._clean, text.split()) if t]
        own = [(i, i + len(tokens) - 1) for i in range(len(plain) - len(tokens) + 1) if tokens and all(names._same(plain[i + k], tokens[k]) for k in range(len(tokens)))]
        glued = "".join(tokens)
        if not own and len(glued) >= 4:
            own = [(i, i) for i, p in enumerate(plain) if p == glued or (len(p) >= 6 and glued in p)]
        if not own and len(tokens) == 1 and len(glued) >= 3:
            own = [(i, i) for i, p in enumerate(plain) if p == glued or (len(glued) >= 4 and glued in p)]
        out += [(text, a, b) for a, b in own]
    return out


def test_trie_alignment():
    rng = random.Random(8)
    stock = ["ravi", "ravindra", "rav", "ra", "kumar", "Kum-ar", "kumari", "xkumarix", "zed", "a", "172", "462216", "172462216", "--"]
    for _ in range(600):
        words = [rng.choice(stock) for _ in range(rng.randrange(0, 25))]
        spans = list(dict.fromkeys(" ".join(rng.choice(stock) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 6))))
        boxes = [(100.0 * i, 0.0, 100.0 * i + 50, 12.0) for i in range(len(words))]
        got = [(r[1], r[-2], r[-1]) for r in names.place(words, boxes, [(str(n), s, 0.9) for n, s in enumerate(spans)])]  # a kind a span: none hides another
        want = plain_places(words, spans)
        assert got == list(dict.fromkeys(want))


def test_alignment_in_place_equals_alignment_of_words(spark):
    texts = ["This is to certify that Ravi Kumar Sahu has passed.\n\n  RAVI  kumar,\nravi kumar sahu", "CANDIDATE NAME : Meera Verma\nmeera\tverma x", "none", "", None, "candidate name: Asha Rao\r\nawarded to ASHA RAO from"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = names.anchored_names(docs).select("doc_id", F.lit("private_person").alias("type"), F.col("name").alias("text"), "confidence")
    there = names.align(spans, tables.word_boxes(tables.lines(docs))).collect()
    here = names.align_texts(docs).collect()
    assert sorted(map(str, there)) == sorted(map(str, here)) and len(here) >= 5


def test_words_of_a_text_are_those_of_its_lines(spark):
    texts = ["a  b\n\n c\td \n", "", " \n ", "é ñ\r\nx y z", "x" * 300 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((r.doc_id, r.ln, r.wi, r.word, (r.x0, r.y0, r.x1, r.y1)) for r in tables.word_boxes(tables.lines(docs)).collect())
    assert [(i, *c) for i, t in enumerate(texts) for c in names.words_of(t)] == want


def test_masks_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "to a@b.org  now\n\n two   c@d.org e@f.org"), (2, "nothing  here"), (3, None), (4, "")], "doc_id long, text string")
    hits = detect.detect(tables.lines(docs), "email")
    got = {r.doc_id: r.text for r in redact.mask(docs, hits).collect()}
    block = redact.BLOCK
    assert got == {1: f"to {block} now\n\ntwo {block} {block}", 2: "nothing  here", 4: ""}
    assert {r.doc_id: r.text for r in redact.redact(tables.lines(docs), hits).collect()} == got
    tagged = redact.mask(docs.filter("doc_id = 1"), hits.withColumn("token", F.concat(F.lit("<T_"), "wi", F.lit(">")))).first().text
    assert tagged == "to <T_1> now\n\ntwo <T_1> <T_2>"


def test_visual_hits_join_the_union(spark):
    """A visual region next to the rules' and the model's: one of its own, and one that joins a region of the same type."""
    docs = spark.createDataFrame([(1, "mail a@b.org\nThis is to certify that Ravi Kumar has"), (2, "plain")], "doc_id long, text string")
    seen = spark.createDataFrame([(1, "face", 0.9, 900.0, 0.0, 960.0, 80.0), (1, "private_email", 0.9, 40.0, 0.0, 96.0, 12.0), (2, "qr_code", 0.8, 0.0, 0.0, 9.0, 9.0)], "doc_id long, type string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, d.type): tuple(d.sources) for r in sanitize.sanitize(docs, visual=seen).collect() for d in r.detections}
    assert got == {(1, "face"): ("visual",), (1, "private_email"): ("rule", "visual"), (1, "private_person"): ("privacy_filter",), (2, "qr_code"): ("visual",)}
    regions = sanitize.fused(sanitize.detections(docs), seen).collect()
    assert {(r.doc_id, r.type): tuple(r.sources) for r in regions} == got


def test_values_below_labels_meet_only_near_ones(spark):
    """The band join finds what all pairs find."""
    rng = random.Random(3)
    rows = []
    for d in range(6):
        for i in range(120):
            word = rng.choice(["Roll", "Registration", "Centre", "123456", "AB12/2345", "7654321", "x", "School"])
            x, y = rng.uniform(-100, 500), rng.uniform(-50, 400)
            rows.append((d, i // 10, i % 10, word, x, y, x + 8 * len(word), y + 12))
    boxed = spark.createDataFrame(rows, "doc_id long, ln long, wi long, word string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.name, r.doc_id, r.ln, r.wi) for r in detect.below(boxed).collect()}
    want = set()
    import re

    labels = {"roll": r"roll", "registration": r"registration", "centre": r"centre|school"}
    value = {"roll": lambda w: 6 <= len(re.sub(r"\D", "", w)) <= 12, "registration": lambda w: bool(re.search(r"[A-Za-z0-9]{2,}/[0-9]{4,}", w) or re.fullmatch(r"[A-Za-z0-9]{5,14}", w)), "centre": lambda w: 5 <= len(re.sub(r"\D", "", w)) <= 8}
    for name, far in (("roll", 55), ("registration", 55), ("centre", 40)):
        for h in rows:
            if re.fullmatch(labels[name], h[3], re.I):
                near = [c for c in rows if c[0] == h[0] and value[name](c[3]) and abs((c[4] + c[6]) / 2 - (h[4] + h[6]) / 2) < far and 4 < c[5] - h[7] < 75]
                if near:
                    c = min(near, key=lambda c: (c[1], c[2]))
                    want.add((name, c[0], c[1], c[2]))
    assert got == want and len(got) > 20


def test_lines_of_slanted_and_overlapping_words():
    word = lambda x, y, h=12: (float(x), float(y), x + 40.0, float(y + h))
    assert ocr.lines_of([]) == []
    assert ocr.lines_of([word(50, 0), word(0, 3), word(100, -3)]) == [[1, 0, 2]]  # one line, slanted
    assert ocr.lines_of([word(0, 40), word(0, 0), word(50, 20)]) == [[1], [2], [0]]
    # the second lies within a row of the first, and to its left; the third within a row of the second, and further left, but 20 below the first
    assert ocr.reading_order([word(100, 0), word(50, 10), word(0, 20)]) == [2, 1, 0]
    assert ocr.lines_of([word(100, 0), word(50, 10), word(0, 20)]) == [[2, 1], [0]]
    # given from below, the run rises and stands as it is
    assert ocr.reading_order([word(0, 20), word(50, 10), word(100, 0)]) == [0, 1, 2]
    # a rising run, and a late word between its two
    assert ocr.reading_order([word(0, 0), word(60, 0), word(30, 2)]) == [0, 2, 1]
    rng = random.Random(6)
    for _ in range(300):
        rows, cols = rng.randrange(1, 9), rng.randrange(1, 9)
        boxes = [word(60 * c, 30 * r + rng.randrange(0, 6)) for r in range(rows) for c in range(cols)]  # rows far enough apart for one order
        given = rng.sample(range(len(boxes)), len(boxes))
        got = ocr.lines_of([boxes[i] for i in given])
        assert [[given[i] for i in line] for line in got] == [list(range(r * cols, r * cols + cols)) for r in range(rows)]
        mixed = [word(rng.randrange(0, 300), rng.randrange(0, 60), rng.choice([8, 12, 20])) for _ in range(rng.randrange(0, 50))]
        lines = ocr.lines_of(mixed)
        assert sorted(i for line in lines for i in line) == list(range(len(mixed)))
        for line in lines:
            middles = [(mixed[i][1] + mixed[i][3]) / 2 for i in line]
            assert all(abs(m - middles[0]) <= ocr.BAND for m in middles)


def test_grouped_words_keep_frames_apart(spark):
    rows = [(d, i, f"w{i}", 50.0 * (i % 3), 20.0 * (i // 3) + i % 3, 50.0 * (i % 3) + 40, 20.0 * (i // 3) + 12) for d in (1, 2) for i in range(9)] + [(None, 0, "x", 0.0, 0.0, 1.0, 1.0), (3, 0, "y", None, 0.0, 1.0, 1.0)]
    words = spark.createDataFrame(rows, "doc_id long, seq long, word string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.doc_id, r.ln, r.wi, r.word) for r in ocr.group_lines(words).collect())
    assert got == [(d, i // 3, i % 3, f"w{i}") for d in (1, 2) for i in range(9)]
    assert ocr.group_lines(words.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<a href='no'>no</a>";</script></head><body>
<ul><li><a href="/x" id="first"> One <b>two</b></a><li><a aria-label="said" href="/y">Z</a></ul><!-- <button>no</button> -->
<div role="button" onclick="f()">Outer <a href="/in">inner</a></div><button title="tip"> </button><input type="text" placeholder="name"><span contenteditable="true"></span>
<form><input name="a" required><input name="b" required value="v"><input type="checkbox" name="c" required checked><input type="radio" name="r" required><input type="radio" name="r" checked>
<select name="s" required><option value="">-</option><option value="1" selected>1</option></select><textarea name="t" required></textarea><input name="d" required disabled><input type="hidden" name="h" required></form>
<p>Form &amp; more<p>Your RESPONSE has
been  recorded</body></html>"""


def test_page_elements(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<b>never closed <i>x")], "page_id long, html string")
    rows = {(r.page_id, r.pre): r for r in html.elements(pages).collect()}
    assert {k[0] for k in rows} == {1, 4} and rows[(4, 0)]["last"] == 1
    lis = [r for r in rows.values() if r.tag == "li"]
    assert len(lis) == 2 and all(r["last"] - r.pre <= 2 for r in lis)  # an item ends where the next begins
    got = [(r.id, r.tag, r.label) for r in html.manifest(pages).filter("page_id = 1").orderBy("id").collect()]
    assert got[:6] == [(1, "a", "One two"), (2, "a", "said"), (3, "div", "Outer inner"), (4, "button", "tip"), (5, "input", "name"), (6, "span", html.UNLABELLED)]
    assert html.manifest(pages, 3).filter("page_id = 1").count() == 3


def test_page_forms(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, PAGE.replace('name="a" required', 'name="a"').replace("></textarea>", ">t</textarea>"))], "page_id long, html string")
    got = {r.page_id: r for r in html.forms(pages).withColumns({"unfilled": html.unfilled(F.col("fields")), "said": html.confirmed(F.col("shown"), ("response has been recorded",))}).collect()}
    assert [f.name for f in got[1].fields if not f.valid] == ["a", "t"] and got[1].unfilled and got[1].said
    assert {f.name: f.filled for f in got[1].fields} == {"a": False, "b": True, "c": True, "r": True, "s": True, "t": False, "d": False, "h": False}
    assert not got[3].unfilled and not got[2].unfilled and got[2].shown == "" and not got[2].said
    urls = spark.createDataFrame([("https://docs.google.com/forms/d/1", True), ("https://docs.google.com/doc/1", False), ("https://x.org/forms/", False), (None, False)], "u string, want boolean")
    assert urls.filter(html.is_form_page(F.col("u")) != F.col("want")).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_plan_of_sanitize(spark, n):
    """Few scans, however often hits are used, and no line is shuffled."""
    docs = spark.createDataFrame([(1, "mail a@b.org")] * n, "doc_id long, text string")
    plan = sanitize.sanitize(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") < 10


def test_batches_of_pages_are_bounded(spark):
    """A worker gets few pages at a time, whatever the partition's size."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    held = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "1000000000")
        html.forms(spark.createDataFrame([(1, "<p>")], "page_id long, html string"))
        assert [int(spark.conf.get(k)) for k in keys] == [html.BATCH_PAGES, html.BATCH_BYTES]
    finally:
        for k, v in zip(keys, held, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
