"""Every registered query and every pipeline stage on nulls, repeats, ties, very long texts, clashing columns and empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillsift.llm import registry

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
CLASH = ("h", "score", "fp", "rank", "_rank", "size", "target", "matches", "n_entities", "copies", "g", "label")


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i) % 997}" for i in range(n))


def rows_of(table):
    item = "what is the capital of a country that lies between two seas. it is the town on the river of that name."
    long = words(1, 60_000)  # some 300 KB in one line
    docs = [(i, f"the and of that with this {words(i, 30)}.", "en", "a", 1) for i in range(30)]
    docs += [(100 + i, f"der und das nicht mit sich {words(50 + i, 30)}.", "de", "b" if i % 2 else None, 1) for i in range(30)]
    docs += [(200, None, None, None, None), (201, "", "en", "a", 0), (201, "", "en", "a", 0), (None, words(3, 40), "en", "c", 9), (None, None, "en", "c", 9)]
    docs += [(202, "12 34 !!", "de", None, 8), (203, long, "en", "a", 1), (204, long, "en", "a", 1), (205, f"the and of {item} with this", "en", "a", 1)]
    docs += [(206, "the and of Mr John Smith, mail jo.smith@example.com, with password: ______", "en", "a", 1), (7, "the and of that with this " + words(7, 31), "en", "a", 1)]
    return {
        "documents": docs, "benchmark": [(1, item), (2, None), (3, ""), (1, item)],
        "labels": [(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, None), (3, 1, 1)],
        "conversations": [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, long), (2, 0, "user", "a"), (2, 0, "user", "<|end|>\\")],
    }[table]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """odd: the cases; clash: the same with more columns; empty: no rows."""
    root = tmp_path_factory.mktemp("tables")
    for t, schema in TABLES.items():
        odd = spark.createDataFrame(rows_of(t), schema)
        odd.coalesce(1).write.parquet(f"{root}/odd/{t}.parquet")
        odd.withColumns({c: F.lit(f"own {c}") for c in CLASH}).coalesce(1).write.parquet(f"{root}/clash/{t}.parquet")
        odd.limit(0).write.parquet(f"{root}/empty/{t}.parquet")
    return root


def plain(df):
    """Rows as text, without the clashing columns; the order of columns doesn't matter."""
    return sorted(str(tuple((c, r[c]) for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folders, name):
    spark.conf.set("spark.quillsift.pii.key", "k")
    run = lambda folder: registry.QUERIES[name](spark, f"{folders}/{folder}")
    got = plain(run("odd"))
    assert got == plain(run("odd"))  # reruns agree
    n_docs = len(rows_of("documents"))
    if name not in ("op5_token_attribution", "op7_decontamination", "op10_chat_format", "op11_lexical_search"):
        assert len(got) == n_docs
    if name == "op7_decontamination":
        assert run("odd").filter("doc_id = 205 AND item_id = 1").count() == 2 and {r.doc_id for r in run("odd").collect()} == {205}
    assert run("clash").count() == len(got)
    if name == "op10_chat_format":
        assert {r.conv_id for r in run("empty").collect()} == {-7}
    else:
        assert plain(run("clash")) == got or name == "op3_pii_surrogates"
        assert run("empty").count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, folders, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{folders}/odd/{t}.parquet/*.parquet'")
    found = duck.sql(registry.ORACLES[name])
    mine = registry.QUERIES[name](spark, f"{folders}/odd").select(*found.columns).collect()
    assert sorted(map(str, map(tuple, mine))) == sorted(map(str, found.fetchall()))


def test_pipeline(spark, folders):
    import corpus_pipeline

    spark.conf.set("spark.quillsift.pii.key", "k")
    found = corpus_pipeline.run(spark, f"{folders}/odd")
    kept = {(r.doc_id, r.text) for r in found.collect()}
    ids = {i for i, _ in kept}
    assert not ids & {200, 201, 202, 205} and not {203, 204} <= ids and ids <= {r[0] for r in rows_of("documents")}
    again = corpus_pipeline.run(spark, f"{folders}/clash")
    assert {(r.doc_id, r.text) for r in again.collect()} == kept
    assert {"mix_size", "mix_target", "mix_copies", "source_size", "taken"} <= set(again.columns)
    assert all(r[c] == f"own {c}" for r in again.collect() for c in CLASH)
    assert corpus_pipeline.run(spark, f"{folders}/empty").count() == 0


@pytest.mark.parametrize("folder", ["odd", "clash", "empty"])
def test_stages_keep_columns(spark, folders, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folders}/{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, f"{folders}/{folder}")
        assert found.dtypes == docs.dtypes and found.count() <= docs.count()
