"""Runs stage by stage: rows, counts, times, and what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from quillsift.operators import redact, sanitize, stages
from quillsift.sources import tables

TEXT = "mail a@b.org\nThis is to certify that Ravi Kumar has\nAPI Token : eyJhbGciOiJIUzI1NiJ9.demo123"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, "plain"), (3, None), (4, "x a@b.org"), (4, "y"), (None, "z")], "doc_id long, text string")


def test_stages_and_audit(spark, docs):
    said = []
    run = stages.Run(told=lambda stage, status: said.append((stage, status)))
    out = run.sanitize(docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, sanitize.sanitize(docs).collect()))
    m = run.metrics
    assert list(m) == list(stages.STAGES) and all(x["status"] == "completed" and x["ms"] >= 0 for x in m.values())
    assert (m["loading"]["n_rows"], m["loading"]["n_null"]) == (6, 1) and m["model"]["n_rows"] == 1 and m["rules"]["n_rows"] >= 3
    assert m["redaction"]["n_rows"] == 6 and m["redaction"]["n_failed"] == 4 and m["redaction"]["n_masked"] >= 4
    assert m["total"]["ms"] >= sum(m[s]["ms"] for s in stages.STAGES[:-1]) - 5
    assert said[:2] == [("loading", "active"), ("loading", "completed")] and len(said) == 10
    audit = {(r.doc_id, r.error): r for r in run.audit(out).collect()}
    one = audit[(1, None)]
    assert set(one.stages_ms) == set(stages.STAGES) and one.processing_ms == m["total"]["ms"] and one.detections == 3 and not one.cloud_exposure
    assert [c for c in run.audit(out).columns if c in ("text", "detections")] == ["detections"]
    raw = stages.Run(on_error="raw")
    exposed = {(r.doc_id, r.error): r.cloud_exposure for r in raw.audit(raw.sanitize(docs)).collect()}
    assert exposed[(3, "no text")] and exposed[(4, "repeated id")] and not exposed[(1, None)]


def test_a_failing_stage_is_told(spark, docs):
    run = stages.Run()
    bad = docs.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        run.sanitize(bad)
    assert run.metrics["loading"]["status"] == "failed" and list(run.metrics) == ["loading"]
    assert [tuple(r)[:2] for r in run.table(docs).collect()] == [("loading", "failed")]


def test_empty_table(spark, docs):
    run = stages.Run()
    assert run.sanitize(docs.limit(0)).count() == 0 and run.metrics["fusion"]["n_regions"] == 0


def test_sinks_and_failing_closed(spark, tmp_path, docs):
    """Redacted rows with and without those that failed; a row without output ends the query; the vault keeps what it is given."""
    out = sanitize.sanitize(docs)
    tables.write_redacted(out, str(tmp_path / "kept"))
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {1, 2}
    tables.write_redacted(sanitize.sanitize(docs, on_error="raw"), str(tmp_path / "raw"), "raw")
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 6
    with pytest.raises(ValueError, match="on_error"):
        tables.write_redacted(out, str(tmp_path / "no"), "keep")
    assert redact.fail_closed(out.filter("sanitized"), "text").count() == 2
    with pytest.raises(Exception, match="no output in text"):
        redact.fail_closed(out, "text").collect()
    at = F.timestamp_seconds(F.lit(86_400) * F.col("id"))
    captures = spark.range(1, 4).withColumns({"created_at": at, "after_image": F.when(F.col("id") != 2, "i"), "sanitized": F.when(F.col("id") == 3, F.lit(False))})
    for _ in range(2):
        tables.append_vault(captures, str(tmp_path / "vault"))
    back = spark.read.parquet(str(tmp_path / "vault"))
    assert back.count() == 6 and {(r.id, r.sanitized) for r in back.collect()} == {(1, True), (2, True), (3, False)}
    assert [r.id for r in tables.export_vault(back).collect()] == [1, 1, 3, 3]


def test_invalid_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.GIF").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r.error for r in tables.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": None, "b.GIF": "extension"}
    named = spark.createDataFrame([("c.jpeg", 0, "empty"), ("d.webp", 11 << 20, "too large"), (None, 1, "missing"), ("e.JPG", 5, None)], "name string, size long, want string")
    assert named.filter(~tables.invalid_reason(F.col("name"), F.col("size")).eqNullSafe(F.col("want"))).count() == 0
