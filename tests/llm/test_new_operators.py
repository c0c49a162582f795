"""Ranked search, piece tables and word runs against plain versions of what they promise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import common, lexical_search, piece_table, registry, word_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DIR = "/root/testdata/sf0.001"


def plain_ranking(docs, items, k=10):
    """Every item against every document, from the contract's words."""
    cut = lambda text: TERM.findall((text or "").translate(ASCII_LOWER))
    held = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs if cut(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for doc, c, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(i, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    often = ["the", "of", "Ünd", "a", "7"]
    text = lambda: " ".join(rng.choice(often) if rng.random() < 0.6 else words[int(rng.random() ** 3 * vocabulary)] for _ in range(rng.randrange(1, 60)))
    return [(i, text()) for i in range(n)]


@pytest.mark.parametrize(("seed_matches", "item_rows"), [(0, 1_000_000), (30, 1_000_000), (10**9, 1_000_000), (30, 0)])
def test_ranking(spark, monkeypatch, seed_matches, item_rows):
    """The bound and the way items are dealt change no row; ties, repeats and nulls as defined."""
    monkeypatch.setattr(lexical_search, "ITEM_ROWS", item_rows)
    docs = corpus(1, 400, 150)
    docs += [docs[3], docs[3], (900, docs[5][1]), (901, None), (902, ""), (903, "-- !"), (None, docs[7][1]), (904, "THE_the É é"), (905, "the " * 3000)]
    items = corpus(2, 25, 150) + [(3, "more of w1 the"), (None, "the w2"), (None, docs[7][1]), (70, None), (71, "nothing-here"), (72, "the"), (73, "É")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    found = lexical_search.rank(frame(docs, "doc_id"), frame(items, "item_id").withColumn("term", F.lit("own")), seed_matches=seed_matches)
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_ranking(docs, items)


def test_ranking_skips_frequent_terms(spark):
    """Terms that can't reach the bound aren't joined in full, and still count."""
    docs = [(i, "the of and " * 3 + (f"rare{i % 7} " * (1 + i % 3))) for i in range(300)]
    items = [(1, "the rare1"), (2, "of and the rare2 rare3")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    found = lexical_search.rank(frame(docs, "doc_id"), frame(items, "item_id"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_ranking(docs, items)


ODD = [
    "", " ", "   ", "\n", " \n ", "\n\n\n", "a", " a", "a ", "a  b", "a\n b\n\n  c ", "\r\n x\r\n", "▁▁ a▁ b", "é ñ 漢字 \u0000 x <s> </s> <0x0A> <unk>", "\t\t\ta",
    "x" * 5000, " " * 3000 + "a", "ab " * 4000, "😀 👍🏽 🇮🇳", "word word word", "ﬁ ligature", "Ｆｕｌｌ",
]


def library(text):
    sp = piece_table.processor()
    ids = sp.encode(text)
    return ids, sp.decode(ids)


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(" \n▁\rabcé;})(*/<s>漢") for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("run", [1, 7, 1 << 20])
def test_chunks_have_the_librarys_ids(monkeypatch, run):
    monkeypatch.setattr(piece_table, "RUN", run)
    known, table = {"▁a": piece_table.np.int32(264).tobytes()}, {}
    for text in odd_texts(run, 800):
        assert "".join(c for found in piece_table.chunks(text) for c in found) == (piece_table.MARK + text.replace(" ", piece_table.MARK) if text else "")
        ids = np.frombuffer(piece_table.encode_text(text, known, table), dtype="<i4")
        assert (ids.tolist(), piece_table.decode_ids(ids)) == library(text)
    assert all(len(c) <= piece_table.LONGEST for c in table)


@pytest.mark.parametrize("table_rows", [0, 3, 1000])
def test_encode(spark, table_rows):
    """The whole operator, with tables of any size, keeps other columns and repeated rows."""
    texts = [*odd_texts(5, 200), "ab " * 4000, None]
    docs = spark.createDataFrame([(i, t, f"own {i}", 1) for i, t in enumerate(texts)] + [(3, "a b", "again", 1), (None, "a b", None, 1)], "doc_id long, text string, `a.b` string, ids int")
    found = piece_table.encode(docs.repartition(3), table_rows=table_rows)
    assert found.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    got = found.collect()
    assert len(got) == docs.count() and all((r.ids, r.decoded) == library(r.text or "") for r in got)
    if table_rows:
        sizes = {r.chunk: len(r.ids) // 4 for r in piece_table.chunk_table(docs, table_rows=table_rows).collect()}
        assert len(sizes) <= table_rows


def test_models_that_cross_markers_are_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file): ...

        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="a▁b"):
        piece_table.processor.__wrapped__("any")


def test_op12_digests(spark):
    docs = common.load(spark, DIR, "documents").collect()
    got = {r.doc_id: r for r in registry.op12_piece_table(spark, DIR).collect()}
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids, text = library(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def plain_runs(words, least=12):
    """All stretches of every period, each as long as it goes, the least period of a stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= least), key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(700):
        texts = []
        for _ in range(rng.randrange(0, 6)):
            n, letters = rng.randrange(0, 80), rng.choice([1, 2, 3, 5])
            words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
            if n and rng.random() < 0.4:
                words = (words[: rng.randrange(1, n + 1)] * n)[:n]
            texts.append(words)
        least = rng.choice([2, 4, 12])
        assert word_runs.runs_of_texts(texts, least) == [plain_runs(w, least) for w in texts]


def test_fibonacci_words_and_long_texts():
    """Words full of runs, and texts of one run, at sizes where anything square would show."""
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    words = [c.encode() for c in b]
    assert word_runs.runs_of_texts([words], 12) == [plain_runs(words)]
    assert word_runs.runs_of_texts([[b"x"] * 200_000, [b"%d" % (i % 777) for i in range(200_000)]]) == [[(0, 200_000, 1)], [(0, 200_000, 777)]]


def plain_op13(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_op13_whole_query(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 120))) for _ in range(200)]
    texts += [None, "", " \n ", "a " * 500, "x y " * 40, "a\x0bb\x0cc\rd\te " * 9, "É é É é É é É é É é É é É é"]
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(5, texts[5], "own"), (5, "a b " * 9, "own")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_word_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_op13(i, t)) for i, t, _ in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows)


def test_runs_operator_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 10, "x"), (None, "a b " * 10, None)], "doc_id long, text string, `start.x` string").withColumn("n_words", F.lit("own"))
    found = word_runs.find_runs(docs)
    assert found.columns == ["doc_id", "start.x", "n_words", "runs", "collapsed"]
    assert [(r.n_words, r.runs, r.collapsed) for r in found.collect()] == [(20, [(0, 20, 2)], "a b")] * 2


def test_texts_share_trees_in_any_number(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b " * (i % 9) + f"c{i}") for i in range(60)], "doc_id long, text string")
    want = sorted(map(str, word_runs.find_runs(docs).collect()))
    monkeypatch.setattr(word_runs, "TREE_WORDS", 1)
    assert sorted(map(str, word_runs.find_runs(docs).collect())) == want


def test_repeated_ids_take_one_place_in_the_sample(spark):
    """Repeated rows of documents and of labels, far more than the sample holds, change no rule."""
    from quillsift.llm import rule_ensemble

    text = lambda i: ("Good words, in order. " * (5 + i % 7)) if i % 2 else ("BUY!!! $$$ ### " * (5 + i % 5))
    docs = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    one = spark.createDataFrame([(7, text(7))] * 900, "doc_id long, text string")
    again = spark.createDataFrame([(7, 1)] * 900, "doc_id long, quality int")

    def rules(d, lab):
        stats = rule_ensemble.statistics(rule_ensemble.parts(d, "doc_id"), "doc_id")
        return rule_ensemble.fit(stats, lab, list(rule_ensemble.NAMES), max_rows=200)

    plain = rules(docs, labels)
    assert plain.rules and plain == rules(docs.union(one), labels) == rules(docs, labels.union(again)) == rules(docs.union(one), labels.union(again))


def test_passages_in_runs_are_the_same(monkeypatch):
    """Bounds on what is held at once change neither passages nor matches."""
    from quillsift.llm import decontaminate

    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 25)))) for i in range(90)]
    index = decontaminate.Index(items, 0.6)
    for _ in range(25):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))) for _ in range(3)]
        text = " ".join([parts[0], items[rng.randrange(90)][1], parts[1], items[rng.randrange(90)][1], parts[2]])
        found = []
        for cells in (1, 40, 1000, 1 << 20):
            monkeypatch.setattr(decontaminate, "CELLS", cells)
            terms = np.array([index.vocabulary.get(w, -1) for w in decontaminate.words_of(text)], dtype=np.int64)
            found.append((index.live(terms).tolist(), index.matches(text, 0.8)))
        assert all(f == found[0] for f in found) and len(found[0][1]) >= 2


def test_memory_of_a_long_text_and_a_large_benchmark():
    import tracemalloc

    from quillsift.llm import decontaminate

    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30_000, 30))) for i in range(8000)]
    index = decontaminate.Index(items, 0.6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 30_000, 300_000)) + " " + items[5][1]
    tracemalloc.start()
    found = index.matches(text, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {index.ids[k] for k in found} == {5} and peak < 200e6
