import pandas as pd
from pyspark.sql import functions as F

from quillsift.functions import entity
from quillsift.operators import detect, fuse, names, pixels, redact, sanitize, trace
from quillsift.sources import tables
from quillsift.streaming import twins


def hits(spark, text, name):
    lined = tables.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    found = detect.detect_email_joined(lined) if name == "email_joined" else detect.detect(lined, name)
    return [r.text for r in found.orderBy("ln", "wi").collect()]


def test_detectors(spark):
    assert hits(spark, "a.b@c.org x", "email") == ["a.b@c.org"]
    assert hits(spark, "mail me a@b.com", "email_joined") == ["mail me"]
    assert hits(spark, "+91 9876543210 and +919876543210 5876543210", "phone") == ["+91 9876543210", "+919876543210"]
    assert hits(spark, "abcde1234f ABCD1234F", "pan") == ["abcde1234f"]
    assert hits(spark, "2345 6789 0123 1345 6789 0123", "aadhaar") == ["2345 6789 0123"]
    assert hits(spark, "Aadhaar: 2345, 6789, 0123.", "aadhaar") == ["2345, 6789, 0123."]
    assert hits(spark, "2345 6789 0123 4567 8901 2345 6789", "aadhaar") == ["2345 6789 0123", "4567 8901 2345"]
    assert hits(spark, "Name : श्री Rahul श्रीमती Sharma", "names") == ["Rahul", "Sharma"]
    assert hits(spark, "savings 123456789\n123456789", "account") == ["123456789"]
    assert hits(spark, "capital abcdefghijklmnop", "secret") == ["abcdefghijklmnop"]
    assert hits(spark, "4111111111111111 4111111111111112", "card") == ["4111111111111111"]
    assert hits(spark, "Registration Number 1234567", "registration") == ["Number", "1234567"]
    assert hits(spark, "Name : Asha Sahu S/O Ravi", "names") == ["Asha", "Sahu", "Ravi"]


def frame(*rows):
    return pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["arrival", "type", "source", "confidence", "x0", "y0", "x1", "y1"])


def test_fusion_grows_and_scores():
    out = fuse.fuse_rows(frame(("secret", "rule", 0.98, 0, 0, 10, 10), ("token", "privacy_filter", 0.98, 1, 1, 9, 9), ("pan", "rule", 0.9, 0, 0, 10, 10)))
    assert [(r[0], r[1], r[2]) for r in out] == [("secret", ["rule", "privacy_filter"], 0.99), ("pan", ["rule"], 0.9)]
    near, far = ("private_person", "rule", 0.98, 0, 0, 10, 12), lambda x: ("private_person", "rule", 0.98, x, 0, x + 10, 12)
    assert len(fuse.fuse_rows(frame(near, far(50)))) == 1
    assert len(fuse.fuse_rows(frame(near, far(51)))) == 2


def test_redaction_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "to a@b.org now\n\nbye")], "doc_id long, text string")
    lined = tables.lines(docs)
    once = redact.redact(lined, detect.detect(lined, "email"))
    assert once.first().text == f"to {redact.BLOCK} now\n\nbye"
    again = tables.lines(once)
    assert redact.redact(again, detect.detect(again, "email")).first().text == once.first().text


def test_repeat_guard_with_nulls(spark):
    t = spark.createDataFrame([(1, 1, "CLICK", None), (1, 2, "CLICK", 5), (1, 3, "TYPE", 5), (1, 4, "CLICK", 5), (1, 5, "CLICK", 5)], "run long, step long, action string, element_id long")
    assert [r.repeated for r in trace.repeat_guard(t, "run", ["step"]).orderBy("step").collect()] == [True, False, False, False, True]


def test_json_repair(spark):
    row = spark.sql("SELECT 'so {''a'': 1, }' AS t").select(trace.repair_json(F.col("t")).alias("j"), trace.repair_json(F.lit("none")).alias("n")).first()
    assert (row.j, row.n) == ('so {"a": 1}'[3:], None)


def test_blobs():
    import numpy as np

    grid = np.array([[2, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 0]])
    assert pixels.blobs(grid, 2, 1) == [(0, 0, 1, 2, 3, 4)]


def test_stream_equals_batch(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type")).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    q = twins.status_stream(stream, ["view"]).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("seen").collect()) == sorted(twins.status_stream(batch, ["view"]).collect())


def test_only_the_base_type_joins():
    """A region of no known type neither takes others in nor is taken in, unless both are visual."""
    out = fuse.fuse_rows(frame(("unknown", "rule", 0.99, 0, 0, 10, 10), ("pan", "rule", 0.96, 0, 0, 10, 10)))
    assert [(r[0], r[-1]) for r in out] == [("unknown", 1), ("pan", 1)]
    seen = frame(("unknown", "visual", 0.99, 0, 0, 10, 10), ("face", "visual", 0.98, 1, 1, 9, 9), ("face", "rule", 0.97, 0, 0, 10, 10))
    assert [(r[0], r[1], r[-1]) for r in fuse.fuse_rows(seen)] == [("face", ["visual"], 2), ("face", ["rule"], 1)]


def test_source_details(spark):
    rows = [("face", ["visual"], "Face (Visual)"), ("pan", ["visual", "rule"], "Visual"), ("signature", ["visual"], "Signature (Visual)"), ("pan", ["rule", "privacy_filter"], "Text (OCR + Model + Rule)"),
            ("pan", ["privacy_filter"], "Text (OCR + Model)"), ("pan", ["rule"], "Text (OCR + Rule)"), ("pan", [], "Text (OCR)")]
    t = spark.createDataFrame(rows, "kind string, sources array<string>, want string")
    assert t.filter(entity.source_detail(F.col("kind"), F.col("sources")) != F.col("want")).count() == 0


def words_of(text):
    rows = [(ln, wi, w, 60.0 * wi, 40.0 * ln, 60.0 * wi + 50, 40.0 * ln + 12) for ln, line in enumerate(text.split("\n")) for wi, w in enumerate(line.split())]
    return pd.DataFrame(rows, columns=["ln", "wi", "word", "x0", "y0", "x1", "y1"])


def aligned(text, *names_):
    spans = pd.DataFrame([("private_person", n, 0.9) for n in names_], columns=["type", "text", "confidence"])
    words = words_of(text)
    return [" ".join(words["word"][r[-2] : r[-1] + 1]) for r in names.align_rows(words, spans)]


def test_alignment():
    assert aligned("Ravi Kumar met ravi, kumar!", "Ravi Kumar") == ["Ravi Kumar", "ravi, kumar!"]
    assert aligned("ravi went to kumar", "Ravi Zed Kumar") == []  # words of a longer span don't match alone
    assert aligned("xravindra came", "ravi") == ["xravindra"] and aligned("xra came", "ra") == []
    assert aligned("ab 172462216 cd", "172 462 216") == ["172462216"]
    assert aligned("Ravi\nKumar", "Ravi Kumar") == ["Ravi", "Kumar"]  # 40 pixels apart
    assert aligned("Ravi Kumar", "Ravi Kumar", "RAVI KUMAR") == ["Ravi Kumar"]


def test_spans_go_on_in_the_next_batch(spark):
    tokens = ["Ravi", "Kumar", "is", "[CLS]", "a", "x@y.z", "</s>", "Bo"]
    labels = ["B-Person", "I-Person", "O", "B-Person", "S-person", "E-email", "B-Person", "B-person"]
    rows = [(d, i, lab, t) for d in (1, 2) for i, (lab, t) in enumerate(zip(labels, tokens, strict=True))]
    parts = [pd.DataFrame([r], columns=["doc_id", "pos", "label", "token"]) for r in rows]
    got = pd.concat(list(names._spans_of(iter(parts))))
    want = [("person", "Ravi Kumar", 0, 1), ("person", "a x@y.z", 4, 5), ("person", "Bo", 7, 7)]
    assert [tuple(r) for r in got[got["doc_id"] == 1][["label", "text", "pos", "pos_to"]].itertuples(index=False)] == want and len(got) == 6
    assert names.decode_spans(spark.createDataFrame(rows, "doc_id long, pos long, label string, token string")).count() == 6
    logits = spark.createDataFrame([([0.1, 0.7, 0.7],), ([5.0, 1.0, 1.0],)], "l array<double>")
    assert [r[0] for r in logits.select(names.best_label(F.col("l"), ["O", "B-a", "B-b"])).collect()] == ["B-a", "O"]


PROFILE = """Customer ID: CUS001782
Name : Rahul Sharma
Email : rahul.sharma@example.com
Phone : +91 9876543210
Address : 42 MG Road, Bhopal, MP - 462001
Account No. : 123456789012
PAN : ABCDE1234F
IFSC : SBIN0001234
API Token : eyJhbGciOiJIUzI1NiJ9.demo123"""


def test_profile_has_nine_regions(spark):
    docs = spark.createDataFrame([(1, PROFILE)], "doc_id long, text string")
    regions = sanitize.fused(sanitize.detections(docs)).orderBy("place").collect()
    kinds = [r.type for r in regions]
    assert kinds == ["secret", "id_number", "private_email", "private_phone", "account_number", "pan", "ifsc", "private_person", "private_address"]
    assert [r.risk for r in regions] == ["critical"] + ["high"] * 6 + ["medium"] * 2 and {r.action for r in regions} == {"mask"}


def test_sanitize(spark):
    docs = spark.createDataFrame([(1, PROFILE), (2, ""), (3, None), (4, "a"), (4, "b"), (None, "c"), (5, "plain  words\n\nstay")], "key long, body string")
    got = {(r["key"], r["error"]): r for r in sanitize.sanitize(docs, "body", "key").collect()}
    assert {k for k in got} == {(1, None), (2, None), (3, "no text"), (4, "repeated id"), (None, "no id"), (5, None)}
    assert got[(5, None)].body == "plain  words\n\nstay" and got[(2, None)].body == "" and got[(4, "repeated id")].body is None
    one = got[(1, None)]
    assert (one.total, one.critical, one.high, one.medium, one.low) == (9, 1, 6, 2, 0)
    shown = one.body + str(one.detections)
    assert not [w for w in ("Rahul", "Sharma", "rahul.sharma", "9876543210", "CUS001782", "462001", "123456789012", "ABCDE1234F", "SBIN0001234", "demo123") if w in shown]
    raw = {r["key"]: r for r in sanitize.sanitize(docs.filter("key = 3 OR key = 4"), "body", "key", on_error="raw").collect()}
    assert raw[4].body in ("a", "b") and not raw[4].sanitized and raw[3].body is None
    allowed = sanitize.sanitize(docs.filter("key = 1"), "body", "key", policy={"critical": "mask", "high": "allow", "medium": "allow", "low": "allow"}).first()
    assert "Rahul Sharma" in allowed.body and "demo123" not in allowed.body


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, PROFILE)], "doc_id long, text string")
    regions = sanitize.fused(sanitize.detections(docs))
    made = redact.manifest(regions, about={"filename": F.lit("p.png")})
    for _ in range(2):
        redact.write_manifest(made, str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m"))
    assert back.count() == 2 and back.first()["summary"]["totalRegions"] == 9 and back.first()["detections"][0]["tag"] == "SECRET"
    redact.write_audit(redact.audit(redact.severity(regions, "doc_id"), F.lit(True)), str(tmp_path / "a"))
    row = spark.read.parquet(str(tmp_path / "a")).first()
    assert row.detections == 9 and not row.cloud_exposure and row.error is None


def test_faces_and_codes(spark):
    """A block of skin in the right zone and a dark square at the lower left, with and without words on them."""
    skin = [(x, y, 200, 140, 110) for x in range(380, 440, 2) for y in range(60, 132, 2)]
    dark = [(x, y, 10, 10, 10) for x in range(40, 104) for y in range(320, 384)]
    rows = [(d, *p) for d in (1, 2) for p in skin + dark]
    pix = spark.createDataFrame(rows, "doc_id long, x int, y int, r int, g int, b int")
    frames = spark.createDataFrame([(1, 640, 480), (2, 640, 480)], "doc_id long, width int, height int")
    said = [(2, w, 385.0 + 10 * i, 80.0, 390.0 + 10 * i, 92.0) for i, w in enumerate(("this", "is", "some", "text", "here"))] + [(2, "code", 50.0, 330.0, 60.0, 340.0), (2, "word", 60.0, 350.0, 70.0, 360.0)]
    words = spark.createDataFrame(said, "doc_id long, word string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, r.type): (r.x0, r.y0, r.x1, r.y1) for r in pixels.visual(pix, frames, words).collect()}
    assert set(got) == {(1, "face"), (1, "qr_code")}
    x0, y0, x1, y1 = got[(1, "face")]
    assert x0 <= 380 and y0 <= 60 and x1 >= 440 and y1 >= 132 and (x1 - x0) / (y1 - y0) <= 1.35
    assert got[(1, "qr_code")][0] <= 40 and got[(1, "qr_code")][3] >= 384


def test_sources(spark):
    cells = spark.createDataFrame([(" hi ", 0, 3.0, 3.0, 900.0, 30.0), (" ", 50, 0.0, 0.0, 1.0, 1.0), ("yo", 95, 1.5, 0.0, 15.0, 30.0)], "word string, confidence int, x0 double, y0 double, x1 double, y1 double")
    out = tables.scanned_words(cells, F.lit(1.5), F.lit(400), F.lit(300)).collect()
    assert [(r.word, r.confidence, r.x0, r.x1) for r in out] == [("hi", 0.8, 2.0, 400.0), ("yo", 0.95, 1.0, 10.0)]
    images = spark.createDataFrame([(None, b"b", "d"), (b"f", b"b", None)], "f binary, b binary, d string")
    assert [r[0]["kind"] for r in images.select(tables.first_source(file=F.col("f"), blob=F.col("b"), dataUrl=F.col("d"))).collect()] == ["blob", "file"]


def streamed(spark, made, name):
    q = made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_streamed_cache_and_sessions_equal_batch(spark, tmp_path):
    path, hour, day = str(tmp_path / "e"), 3_600_000, 1_700_000_000_000  # not at the epoch, where the watermark starts
    rows = [(u, 100 * u + i, day + i * hour // 2, i % 3 == 0) for u in range(3) for i in range(12)]
    e = spark.createDataFrame(rows, "user long, id long, ms long, is_write boolean").withColumn("ts", F.timestamp_millis("ms"))
    for part in range(3):
        e.filter(F.col("ms").between(day + part * 2 * hour, day + part * 2 * hour + 2 * hour - 1)).coalesce(1).write.mode("append").parquet(path)
    e = spark.read.parquet(path)
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.id, r.hit) for r in streamed(spark, twins.ttl_cache(stream(), "user", 2 * hour), "cached").collect()}
    want = trace.ttl_lookup(e, "user", "ts", "id", F.col("is_write"), ~F.col("is_write"), 2 * 3600)
    assert got == {(r.id, r.hit) for r in want.collect()}
    closed = streamed(spark, twins.sessions(stream(), "user", "ts", "20 minutes", "1 minute"), "closed").collect()
    assert {(r.user, r.start) for r in closed} <= {(r.user, r.start) for r in trace.sessions(e, "user", "ts", 20 * 60, "id").collect()} and closed
    one = streamed(spark, twins.first_result(stream(), ["user"], "ts", "100 hours"), "firsts").collect()
    assert len(one) == 3
