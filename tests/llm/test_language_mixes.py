"""The flag of ambiguity: texts of two languages have it, those of one hardly ever."""

import os
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from quillsift.llm import language_id

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    docs = pd.read_parquet(f"{DIR}/documents.parquet", columns=["doc_id", "text", "lang"]).dropna()
    held = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in docs["doc_id"]])
    model = language_id.fit_bits(language_id.features(list(docs["text"][~held])), list(docs["lang"][~held]))
    return model, docs[held]


def halves(docs, share=0.5):
    """Texts that begin in one language and go on in another, for each two languages."""
    texts = {g: [t.split()[:300] for t in d["text"] if len(t.split()) >= 40] for g, d in docs.groupby("lang")}
    for a, b in combinations(sorted(texts), 2):
        for x, y in zip(texts[a], texts[b], strict=False):
            n = min(len(x), len(y))
            yield (a, b), " ".join(x[: int(n * share)] + y[: n - int(n * share)])


def test_mixed_texts_are_flagged_and_others_not(labelled):
    model, docs = labelled
    pairs, texts = zip(*halves(docs), strict=True)
    lead = language_id.decode_texts(model, list(texts))[2]
    flagged = pd.Series(lead < model.bound).groupby(pd.Index([f"{a}-{b}" for a, b in pairs])).mean()
    assert len(flagged) == 6 and flagged.min() >= 0.8, flagged
    best, _, lead = language_id.decode_texts(model, list(docs["text"]))
    assert (lead < model.bound).mean() <= 0.04
    assert (np.array(model.langs)[best] == docs["lang"]).mean() >= 0.98


def test_flag_in_a_table(spark, labelled):
    model, docs = labelled
    mixed = [t for _, t in halves(docs)][:30]
    rows = [(i, t) for i, t in enumerate([*mixed, *docs["text"][:30], None, "", "123"])]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(out[i].ambiguous for i in range(30)) >= 24 and sum(out[i].ambiguous for i in range(30, 60)) <= 3
    assert [(out[i].lang_pred, out[i].score, out[i].ambiguous) for i in (60, 61, 62)] == [("und", 0.0, False)] * 3
    never = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, ambiguous_below=0.0)
    assert not never.filter("ambiguous").count()


def test_bound_of_few_languages():
    rng = np.random.default_rng(1)
    x = language_id.features(["".join(rng.choice(list("abcdef "), 60)) for _ in range(6)])
    assert language_id.fit_bits(x, ["a"] * 6).bound == 0.0
    assert language_id.fit_bits(x[:0], []).bound == 0.0
    assert 0.0 <= language_id.fit_bits(x, ["a", "b"] * 3).bound <= 1.0
