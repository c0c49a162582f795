import random
import re

import pytest
from pyspark.sql import functions as F

from quillsift.functions import patterns as P
from quillsift.operators import detect, names, sanitize

GATES = {**{f"{k}-{u}": g for u in (False, True) for k, g in detect.gates(u).items()}, "address": P.edged(P.ADDRESS_LABEL), **{f"anchor-{i}": f"(?i){a}" for i, (a, _) in enumerate(names.ANCHORS)}}
PARTS = (
    "name", "NAME", "xname", "éname", "name_", "nameé", "Roll", "roll\x0bno", "reg.\tno", "REG", "a/c", "cif", "cust \n id", "school/centre", "addr", "br.\x0caddress", "नाम", "पता", "श्री", "श्रीमती :",
    "SHRI / SMT. / KUM. :", "certified\x0bthat ", "Candidate's name : ", "given\r\nto ", "माता का नाम :", "पिता / पति का नाम -", "toKen", "toſhri", "token", "@", "0", "2345", "6789 0123", "9(87)65-43210", "98", "२",
    "4111-1111-1111-1111", "12345678-90ab-cdef-1234-567890abcdef", "eyJ", "퟿", "\U0001f600", "\0", " ", "\n", " ", "-", "_", ".",
)


@pytest.mark.parametrize("batch", [1, 1000])
def test_gates_lose_nothing(spark, batch):
    """Whatever Java's patterns find in a text, the automaton has let through; in ASCII text it lets through nothing else."""
    draw = random.Random(5)
    texts = ["", *PARTS, *("".join(draw.choices(PARTS, k=draw.randint(2, 9))) for _ in range(1500)), *(" ".join(draw.choices(PARTS, k=3)) for _ in range(500))]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch if batch > 1 else 7)
        docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
        got = docs.select("text", *(F.struct(F.col("text").rlike(g).alias("java"), P.may_hold(F.col("text"), g).alias("gate")).alias(k) for k, g in GATES.items())).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    for r in got:
        for k in GATES:
            assert not r[k].java or r[k].gate, (k, r.text)
            assert r.text is None or not r.text.isascii() or r[k].java == r[k].gate, (k, r.text)
    assert all(any(r[k].java for r in got) for k in GATES)


@pytest.mark.parametrize("step", [sanitize.detections, sanitize.model_hits, detect.detect_all])  # the query sanitize; the stages of stage_counts
def test_no_pattern_runs_on_every_text(spark, step):
    """Java's patterns see texts and lines only after the automaton has; before, six of them ran over each text."""
    docs = spark.createDataFrame([(1, "mail a@b.org")], "doc_id long, text string")
    plan = step(docs)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter " in x]
    assert filters and not [x for x in filters if re.search(r"RLIKE\((text|line)#\d+, [^^]|regexp_extract_all\(text#", x)]


def test_sifted_lines_have_all_hits(spark):
    """The rules find the same in sifted lines as in all lines."""
    draw = random.Random(6)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(draw.choices(PARTS, k=5)) for _ in range(6))) for i in range(200)] + [(-1, None)], "doc_id long, text string")
    simple = tuple(n for n in detect.ORDER if n not in ("email_joined", "address"))
    for hindi in (False, True):
        every = detect.detect_many(detect.tables.lines(docs), simple, hindi)
        got = detect.detect_many(detect.sifted_lines(docs, simple, hindi), simple, hindi, sifted=True)
        assert sorted(map(str, got.collect())) == sorted(map(str, every.collect())) != []
