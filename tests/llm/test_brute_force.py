"""Operators that SQL can't express, against plain versions of what they promise."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import common, decontaminate, language_id, mixing, registry, rule_ensemble, suffix_dedup, surrogates, token_spans


def test_loss_weighted_decoding():
    rng = np.random.default_rng(4)
    for k in (2, 3, 5, 9):
        codes = language_id.codewords(k)
        assert len({tuple(c) for c in codes}) == k
        bits = codes.shape[1]
        trust = rng.random(bits).astype(np.float32)
        model = language_id.Model(tuple("abcdefghi"[:k]), codes, rng.normal(size=(language_id.DIMS, bits)).astype(np.float32), np.zeros(bits, dtype=np.float32), trust / trust.sum())
        x = rng.random((40, language_id.DIMS)).astype(np.float32)
        best, score, lead = language_id.decode(model, x)
        for i in range(len(x)):
            margin = x[i] @ model.weights + model.bias
            cost = [sum(float(model.trust[b]) * math.log1p(math.exp(-float(codes[g, b]) * float(margin[b]))) for b in range(bits)) for g in range(k)]
            share = np.exp(-4 * (np.array(cost) - min(cost)))
            share = np.sort(share / share.sum())
            assert cost[best[i]] <= min(cost) + 1e-4 and abs(score[i] - share[-1]) < 1e-3 and abs(lead[i] - (share[-1] - share[-2])) < 2e-3


def test_features_of_whole_texts():
    texts = ["", "Ab cd!", "é" * 5, "x" * 700_000 + " tail"]
    got = language_id.features(texts)
    for text, row in zip(texts, got, strict=True):
        want = np.zeros(language_id.DIMS)
        raw = b"  " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b"  "
        for i in range(1, len(raw) - 1):
            if raw[i] != 32:
                want[((((raw[i - 1] << 16) | (raw[i] << 8) | raw[i + 1]) * 2654435761) % 2**32) >> 20] += 1
        assert np.allclose(row, np.sqrt(want / max(1, want.sum())), atol=1e-4)


def test_sample_of_repeated_ids(spark):
    """An id on most rows takes one place, and reruns agree."""
    rows = [(i, f"text {i}", ("de", "en")[i % 2]) for i in range(400)] + [(1, f"copy {j}", "en") for j in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [sorted(map(tuple, language_id._sample(docs, 50, 80).collect())) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == len({r[0] for r in got[0]}) == 80


def test_permutations_are_bijections():
    key = b"secret"
    for radices in ([7], [10, 10], [3, 4, 5], [26, 10, 2, 3]):
        every = [[]]
        for r in radices:
            every = [v + [d] for v in every for d in range(r)]
        out = [tuple(surrogates.permute(key, "t", v, radices)) for v in every]
        assert len(set(out)) == len(every) and all(0 <= d < r for v in out for d, r in zip(v, radices, strict=True))
    cards = [f"4{n:015d}" for n in range(0, 10**15, 10**15 // 400)]
    made = [surrogates.surrogate(key, "card", c[:-1] + next(d for d in "0123456789" if surrogates.luhn(c[:-1] + d))) for c in cards]
    assert len(set(made)) == len(cards) and all(surrogates.luhn(c) and c[0] == "4" for c in made)


def test_surrogates_joined_and_shared_agree(spark):
    """Names of one syllable pattern collide, so some draw again; both ways to hand these on give the same texts."""
    names = [f"{chr(65 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 7)}" for i in range(900)]
    docs = spark.createDataFrame([(i, f"Mr {n} wrote to Mr {n}.") for i, n in enumerate(names)], "doc_id long, text string")
    where, again = surrogates.redraws(docs, "k")
    assert not again.isEmpty()
    shared, joined = (sorted(map(tuple, surrogates.pseudonymize(docs, "k", max_shared=m).collect())) for m in (50_000, 0))
    assert shared == joined
    new = [re.fullmatch(r"Mr (\w+) wrote to Mr (\w+)\.", t) for _, t, _ in shared]
    assert all(m and m[1] == m[2] for m in new)  # coreference
    by = {n.lower(): m[1].lower() for n, m in zip(names, new, strict=True)}
    assert len(set(by.values())) == len(by) and not set(by.values()) & set(by)  # distinct, and none is a real value of another
    with pytest.raises(ValueError):
        surrogates.pseudonymize(docs, "")


def filled(sizes, weights, most):
    """Targets by filling up one source after the other."""
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing_targets_and_rounding(spark):
    rng = random.Random(9)
    names = ["b", "a", "É", "z", "tiny", None]
    rows = [(i, names[min(rng.randrange(9), 5)], rng.choice([0, 1, 5, 20, 400])) for i in range(1500)] + [(5000 + i, "tiny", 3) for i in range(2)] + [(9000, "z", 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, sized=docs).collect()
    sizes = {s: sum(z for _, x, z in rows if x == s) for s in names}
    order = sorted((s for s in names if s is not None)) + [None]
    want = filled(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3)
    for s in names:
        mine = [r for r in got if r.source == s]
        taken = sum(r.taken for r in mine)
        assert abs(mine[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken - want[s]) <= max(z for _, x, z in rows if x == s)
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in mine)
        rates = sorted({(r["size"], r.rate) for r in mine if r["size"]})
        slopes = [math.log(r / (3 - r)) for _, r in rates if 0 < r < 3]  # the logit of a rate is linear in the size
        sizes_ = [z for z, r in rates if 0 < r < 3]
        if len(slopes) > 2:
            fit = np.polyfit(sizes_[:3], slopes[:3], 1)
            assert abs(np.polyval(fit, sizes_[2]) - slopes[2]) < 1e-6 * max(1, abs(slopes[2]))


def test_unsettled_multipliers_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 3)], "doc_id long, source string, size long")
    cells = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    goals = spark.createDataFrame([("a", 10, 1, 5.0)], "key string, source_size long, n_docs long, target double")
    with pytest.raises(RuntimeError):
        mixing.multipliers(cells, goals, rounds=1)


@pytest.mark.parametrize("rule", ["majority", "start", "split"])
def test_tokens_one_by_one(rule):
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 40)
        cuts = sorted(rng.sample(range(1, 80), min(n, 30)))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, 80])
        edges = sorted(rng.sample(range(0, 81), 6))
        sections = [(edges[i], edges[i + 1], "x") for i in range(0, 6, 2)]
        want = np.zeros(len(sections) + 1)
        for s, e in zip(starts, ends, strict=True):
            share = [max(0, min(e, hi) - max(s, lo)) for lo, hi, _ in sections]
            share.append(e - s - sum(share))
            if rule == "split":
                want += np.array(share) / (e - s)
            elif rule == "start":
                want[next((k for k, (lo, hi, _) in enumerate(sections) if lo <= s < hi), -1)] += 1
            else:
                most = max(share[:-1])
                want[share.index(most) if most and most >= share[-1] else -1] += 1
        assert np.allclose(token_spans.allocate(starts, ends, sections, rule), want)


def edited(rng, words, vocabulary):
    """An item with a few of its words changed, dropped or doubled."""
    words = list(words)
    for _ in range(rng.randrange(0, 3)):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[i], words[i]]])
    return words


def test_blocks_of_items_and_recall(spark):
    """Matches and scores don't depend on the size of a block; edited copies are found as by brute force."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(20, 45))) + ". " + " ".join(rng.choices(vocabulary, k=6)) + ".") for i in range(40)]
    docs = []
    for d in range(120):
        body = rng.choices(vocabulary, k=rng.randrange(20, 200))
        if d % 2:
            at = rng.randrange(len(body))
            body[at:at] = edited(rng, items[d % 40][1].split(), vocabulary)
        docs.append((d, " ".join(body)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (77, None)], "item_id long, text string")
    found = [sorted(map(tuple, decontaminate.contaminated(df, bench, block_items=b).collect())) for b in (1, 3, 20000)]
    assert found[0] == found[1] == found[2] and found[0]
    want = set()
    for d, text in docs:
        have = decontaminate.shingles(decontaminate.words_of(text))
        want |= {(d, i) for i, t in items if len((own := decontaminate.shingles(decontaminate.words_of(t))) & have) >= 0.8 * len(own)}
    got = {(d, i) for d, i, _, _ in found[2]}
    assert len(want) > 20 and got <= want and len(got) >= 0.9 * len(want)


def test_statistics_and_rules(spark):
    """The statistics and the compiled column against Python, score by score."""
    texts = ["", None, "One two. Two!! three?\nOne two\n\nOne two", "a|b #c $d %e <f> g,h;i:j 123 ABC", "Ünïcode wörds – here…  and\tthere\r\n", "x" * 50_000 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in rule_ensemble.statistics(rule_ensemble.parts(docs, "doc_id"), "doc_id").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words, lines, marks = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n"), re.split(r"[.!?]+", t)
        n, count = max(1, len(words)), lambda chars, t=t: sum(map(t.count, chars))
        want = (
            len(words), len(t) / n, len(set(words)) / n, len(set(marks)) / len(marks), len(set(lines)) / len(lines), len(words) / len(lines), len(words) / len(marks),
            count("#*$%&<>") / n, count("|") / n, count("!?") / n, count(".") / n, count(",;:") / n, count("0123456789") / max(1, len(t)), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(1, len(t)),
        )
        assert np.allclose([got[i][k] for k in rule_ensemble.NAMES], want), (i, t[:30])
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    rules = rule_ensemble.learn(x, y, ["a", "b", "c"])
    assert any(len(parts) > 1 for _, parts in rules.rules) and len(rules.rules) < 120
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").withColumn("s", rules.column())
    for r in frame.collect():
        total = rules.bias + sum(w for w, parts in rules.rules if all((r[f] <= c) if s == "<=" else (r[f] > c) for f, s, c in parts))
        total += sum(k * min(max(r[f], lo), hi) for k, f, lo, hi in rules.slopes)
        assert abs(r.s - 1 / (1 + math.exp(-total))) < 1e-9
    right = sum((r.s >= 0.5) == (r.a > 0.5 and r.b <= 0.7) for r in frame.collect())
    assert right >= 490


def test_suffix_arrays():
    rng = random.Random(2)
    for n, alphabet in ((0, b"a"), (1, b"a"), (300, b"a"), (500, b"ab"), (2000, b"abcd\xff\x00")):
        data = np.frombuffer(bytes(rng.choice(alphabet) for _ in range(n)), dtype=np.uint8)
        raw = data.tobytes()
        order = suffix_dedup.suffix_array(data).tolist()
        assert order == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(data, np.array(order, dtype=np.int64)).tolist()
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_settings(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        common.small_batches(spark)
        assert spark.conf.get(name) == "7"  # smaller ones stay
    finally:
        spark.conf.set(name, before)

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):  # no machine-local folder on a cluster
        common.scratch_root(Far)
    spark.conf.unset("spark.quillsift.pii.key")
    assert len(registry.pii_key(spark)) == 64 and registry.pii_key(spark) == registry.pii_key(spark)


def test_large_class_without_common_windows(spark):
    """A class of several shards whose pieces share a gram and no window, and a shard with no repeat: no runs, no error."""
    rng, width = np.random.default_rng(5), 40
    piece = lambda: rng.integers(0, 256, 400, dtype=np.uint8).tobytes()
    rows = [(1, k, k, 1, shards, bytearray(piece())) for shards in (1, 2) for k in range(6)]
    parts = spark.createDataFrame(rows, "cls long, d1 long, d2 long, c long, shards long, piece binary")
    assert suffix_dedup._merge_pairs(parts.filter("shards = 2"), width).count() == 0
    assert suffix_dedup._sort_packed(parts.filter("shards = 1").drop("shards"), width, 1000).count() == 0
    again = parts.filter("shards = 2 AND d1 < 2").unionByName(parts.filter("shards = 2 AND d1 = 0").withColumn("d1", F.lit(3).cast("long")))
    assert sorted(tuple(r) for r in suffix_dedup._merge_pairs(again, width).collect()) == [(1, 0, 0, 0, 400), (1, 3, 0, 0, 400)]
