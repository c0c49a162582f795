"""The corpus operators against brute force, on small fixtures with nulls, ties and repeats."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import chat_format, decontaminate, language_id, line_clean, mixing, near_copies, registry, rule_ensemble, simhash, suffix_dedup, surrogates, token_spans

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "one two three four", "en", "b", 9), (3, "12 34 !!", "de", None, 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("score", F.lit("clash"))


def test_language(spark, odd):
    rng = random.Random(3)
    words = {"en": "the and of that with this".split(), "de": "der und das nicht mit sich".split(), "fr": "le et les dans une pour".split()}
    rows = [(i, " ".join(rng.choices(words[g], k=12)), g, "s", 1) for i in range(150) for g in [sorted(words)[i % 3]]]
    docs = spark.createDataFrame(rows, DOC)
    found = language_id.identify(docs, language_id.fit(docs)).collect()
    assert all(r.lang_pred == r.lang for r in found)
    model = language_id.fit(docs)
    got = {(r.doc_id, r.text): r for r in language_id.identify(odd, model).collect()}
    assert got[(1, None)].lang_pred == got[(3, "12 34 !!")].lang_pred == "und" and len(got) == 4
    assert language_id.identify(odd.limit(0), language_id.fit(odd.limit(0))).count() == 0


def test_simhash_links_are_exact(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)} | set(base)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(sorted(fps))]
    want = list(range(len(rows)))
    u = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    while True:
        new = [min(want[j] for j in np.flatnonzero(near[i])) for i in range(len(u))]
        if new == want:
            break
        want = new
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    for leaf in (3, 8192):
        got = {r.fp: r.component_id for r in simhash.classes(prints, leaf_rows=leaf).collect()}
        assert [got[fp] for _, fp in rows] == want


def test_simhash_edges(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.deduplicate(odd).filter("doc_id = 2").count() == 0
    assert simhash.simhash(np.array([3, 1], dtype=np.uint64)) == 1


def test_surrogates(spark, odd):
    key = b"k"
    mails = [f"u{i}.{i:02d}@mail{i % 9}.example.com" for i in range(300)]
    assert len({surrogates.surrogate(key, "email", m) for m in mails}) == 300
    text, n = surrogates.rewrite("Mrs. Anna Smith, card 4111111111111111, ip 10.1.2.3. Smith!", key, {})
    assert n == 5 and "Smith" not in text and "4111111111111111" not in text and "10.1.2.3" not in text
    assert text == surrogates.rewrite("Mrs. Anna Smith, card 4111111111111111, ip 10.1.2.3. Smith!", key, {})[0]
    docs = spark.createDataFrame([(i, f"Mr {chr(65 + i % 26)}{chr(97 + i // 26)}x and Mr Bo") for i in range(400)], "doc_id long, text string")
    one = sorted(surrogates.pseudonymize(docs, "k").collect())
    assert one == sorted(surrogates.pseudonymize(docs, "k", max_shared=-1).collect()) or surrogates.redraws(docs, "k")[1].isEmpty()
    assert len({r.text for r in one}) == 400
    assert surrogates.pseudonymize(odd, "k").filter("n_entities > 0").count() == 0


def test_mixing(spark, odd):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(0, 40), "x", ["a", "b", None][i % 7 % 3], 1) for i in range(400)], DOC)
    rows = mixing.mix(docs.select("doc_id", "source", "text")).collect()
    assert len(rows) == 400 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    for s in ("a", "b", None):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(40, 0.02 * mine[0].target)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6 * total + 1
    assert rows == mixing.mix(docs.select("doc_id", "source", "text")).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.select("doc_id", "source", "text")).collect()))
    assert mixing.mix(odd).count() == len(ODD)


def test_tokens(odd):
    text = "Lead line\nélan | café\n\nbody 😀 text"
    starts, ends = token_spans.token_spans(text)
    for rule in ("majority", "start", "split"):
        assert abs(token_spans.allocate(starts, ends, token_spans.line_sections(text), rule).sum() - len(starts)) < 1e-9
    assert token_spans.allocate(np.array([0, 3]), np.array([3, 8]), [(0, 4, "x"), (4, 8, "y")], "majority").tolist() == [1, 1, 0]
    assert token_spans.allocate(np.array([3]), np.array([5]), [(0, 4, "x"), (4, 8, "y")], "split").tolist() == [0.5, 0.5, 0]
    assert token_spans.attribute(odd).count() == len(ODD)


def test_lines(odd):
    words = ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert line_clean.n_repeat_words(words * 2) == 16 and line_clean.n_repeat_words(words) == 0
    assert line_clean.judge(None, line_clean.Limits())[:7] == (0, 0, 0, 0, 0, True, False)
    assert line_clean.clean(odd).count() == len(ODD)


def test_wand_equals_brute_force(spark, odd):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30))) + ".") for i in range(30)]
    index = decontaminate.Index(items, 0.4)
    for _ in range(100):
        terms = sorted({index.vocabulary[w] for w in rng.sample(vocabulary, 25) if w in index.vocabulary})
        want = {}
        for t in terms:
            for k, x in zip(index.items[t], index.impacts[t], strict=True):
                want[k] = want.get(k, 0) + x
        assert dict(index.search(terms)) == pytest.approx({k: v for k, v in want.items() if v >= 0.4 - 1e-9})
    docs = spark.createDataFrame([(1, f"before {items[3][1]} after"), (2, "w1 w2")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([*items, (99, None)], "item_id long, text string"))
    assert 3 in {r.item_id for r in found.filter("doc_id = 1").collect()}
    assert decontaminate.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_rules(spark, odd):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    rules = rule_ensemble.learn(x, y, ["a", "b", "c"])
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    assert frame.filter((rules.column() >= 0.5) != (F.col("y") > 0)).count() <= 12
    assert rule_ensemble.score(odd, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).count() == len(ODD)


def repeats(texts, width):
    counts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    for t in texts:
        on = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                on[i : i + width] = b"\1" * width
        kept = bytes(b for b, x in zip(t, on, strict=True) if not x)
        yield len(t), sum(on), sum(1 for i in range(len(t)) if on[i] and (i == 0 or not on[i - 1])), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark):
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh \n") for _ in range(150))
    rows = [(i, "".join(rng.choice("abcd é") for _ in range(rng.randrange(200))) + shared[s : s + 70] + "xy" * (60 if i % 7 == 0 else 0)) for i in range(25) for s in [rng.randrange(60)]]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "q" * 500)]
    want = list(repeats([(t or "").encode() for _, t in rows], 40))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"shard_bytes": 600, "paired": 50}, {"shard_bytes": 300, "paired": 2}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, width=40, **sizes).collect()}
        assert [got[i] for i, _ in rows] == want


def test_chat(spark):
    for text in ("</s>[INST] ok [/INST]", "a\\<|end|>\\\\", "<\\/s>", "<</SYS>>", ""):
        turns = spark.createDataFrame([("user", text)], "role string, text string")
        assert chat_format.parse(chat_format.render(turns).first().segment) == [("user", text)]
    for role in ("us\ner", "a\\nb", "\n", "\\", "<|turn|>\n<s>\\n", "\\\\n"):
        turns = spark.createDataFrame([(role, "x\ny\\n")], "role string, text string")
        assert chat_format.parse(chat_format.render(turns).first().segment) == [(role, "x\ny\\n")]
    records = spark.createDataFrame([(1, "do", "", "done"), (2, "do", "this", None)], "id long, instruction string, input string, output string")
    assert [(r.role, r.text) for r in chat_format.canonical_turns(records, "id").orderBy("conv_id", "turn").collect()] == [("user", "do"), ("assistant", "done"), ("user", "do\n\nthis"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat_format.canonical_turns(records.withColumn("odd", F.lit(1)), "id")
    ties = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    row = chat_format.read_back(ties).first()
    assert row.n_turns == 3 and row.turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\nb\n").hexdigest()


def test_chat_layouts_of_the_query(spark, tmp_path):
    """The query takes whatever layout its table has, by fingerprint; each gives the same digests."""
    flat = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "yes"), (2, 0, "user", ""), (2, 1, "assistant", "b\\c")]
    rows = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string")
    listed = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    texts = F.map_from_entries(F.collect_list(F.struct("role", "text")))
    paired = rows.groupBy("conv_id").agg(texts.alias("m")).select("conv_id", F.col("m.user").alias("prompt"), F.col("m.assistant").alias("response"))
    got = []
    for i, table in enumerate((rows.withColumn("other", F.lit(1)), listed, paired)):
        table.write.parquet(f"{tmp_path}/{i}/conversations.parquet")
        got.append(sorted(map(tuple, registry.op10_chat_format(spark, f"{tmp_path}/{i}").collect())))
    assert len(got[0]) == 3 and got[0] == got[1] == got[2]
    rows.withColumnRenamed("text", "body").write.parquet(f"{tmp_path}/odd/conversations.parquet")
    with pytest.raises(ValueError):
        registry.op10_chat_format(spark, f"{tmp_path}/odd")


def test_pipeline_drops_every_near_copy(spark, odd):
    """Groups as by brute force over five-word shingles, whatever the sample that orders them."""
    import corpus_pipeline

    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))] for _ in range(12)]
    texts, common = [], "one line that very many of these documents have in common".split()
    for i in range(150):
        words = list(base[i % 12]) + (common if i % 3 == 0 else [])
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"e{i}"
        texts.append(" ".join(words))
    texts += [" ".join([*common, f"x{i}"]) for i in range(30)] + [texts[0], "a b", "A  b", "a c"]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    want = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert sum(sets[i] != sets[j] for i, j in pairs) > 100
    for _ in want:
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sample in (0, 20_000):
        got = near_copies.near_copies(docs, sample).groupBy("root").agg(F.min("doc_id").alias("d"), F.collect_list("doc_id").alias("all")).collect()
        assert {i: r.d for r in got for i in r["all"]} == dict(enumerate(want))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(want))
    assert [r.doc_id for r in near_copies.deduplicate(odd).filter("doc_id < 3").collect()] == [1] and near_copies.deduplicate(odd.limit(0)).count() == 0


def test_several_layouts_in_one_table(spark):
    rows = [(1, "p", "c", None, None, None, None), (2, None, None, "do", "done", None, None), (3, None, None, "do", "done", "this", None), (4, None, None, None, None, None, [("human", "a"), ("gpt", "b")]), (5, "p", None, None, "x", None, None), (6, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "id long, prompt string, completion string, instruction string, output string, input string, conversations array<struct<`from`: string, value: string>>")
    turns, unknown = chat_format.mixed_turns(table, "id")
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "p"), ("assistant", "c")], 2: [("user", "do"), ("assistant", "done")], 3: [("user", "do\n\nthis"), ("assistant", "done")], 4: [("user", "a"), ("assistant", "b")]}
    assert {tuple(r.paths): r.n for r in unknown.collect()} == {("output", "prompt"): 1, (): 1}


def test_records_of_one_nested_column(spark, tmp_path):
    """Fingerprints look into arrays: messages under two names, empty ones, and the query on a table of several layouts."""
    rows = [(1, [("human", "a", None), ("gpt", "b", None)], None, None), (2, [("user", None, "c")], None, None), (3, None, "p", "r"), (4, [], None, None), (5, [("user", "x", "y")], None, None)]
    table = spark.createDataFrame(rows, "conv_id long, messages array<struct<role: string, content: string, text: string>>, prompt string, response string")
    turns, unknown = chat_format.mixed_turns(table, "conv_id")
    assert sorted(map(tuple, turns.collect())) == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (3, 0, "user", "p"), (3, 1, "assistant", "r")]
    assert {tuple(r.paths): r.n for r in unknown.collect()} == {("messages[].content", "messages[].role", "messages[].text"): 2}
    assert turns._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # one scan
    table.filter("conv_id < 4").write.parquet(f"{tmp_path}/m/conversations.parquet")
    got = {r.conv_id: r.n_turns for r in registry.op10_chat_format(spark, f"{tmp_path}/m").collect()}
    assert got == {-7: 2, 1: 2, 2: 1, 3: 2}
    table.write.parquet(f"{tmp_path}/bad/conversations.parquet")
    with pytest.raises(Exception, match="no mapping for the layout"):
        registry.op10_chat_format(spark, f"{tmp_path}/bad").collect()
