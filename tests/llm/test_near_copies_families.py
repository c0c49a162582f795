"""Near copies: families of edited copies on both sides of the threshold, and long texts that share phrases by chance."""

import random
from itertools import combinations

import pytest

from quillsift.llm import near_copies


def _counted(monkeypatch):
    """How many pairs the exact comparison was asked for, each time."""
    asked, similar = [], near_copies._similar

    def told(docs, alike, pairs):
        asked.append(pairs.count())
        return similar(docs, alike, pairs)

    monkeypatch.setattr(near_copies, "_similar", told)
    return asked


def _roots(spark, texts):
    rows = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.doc_id: r.root for r in rows.collect()}


def _expected(texts):
    """The least number reachable, by comparing all pairs."""
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sets))]


def _edited(rng, words, n, drop=0):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.random()}"
    return out[: len(out) - drop]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_have_the_groups_of_all_pairs(spark, seed):
    """Copies of a text, edited in few to many words or cut short, with and without the text itself."""
    rng = random.Random(seed)
    texts = []
    for family in range(6):
        base = [f"w{family}.{rng.randrange(80)}" for _ in range(rng.choice([12, 60, 300, 700]))]
        for _ in range(14):
            one = _edited(rng, base, rng.randrange(1 + len(base) // 22), rng.randrange(1 + len(base) // 10))
            texts += [" ".join(one), " ".join(_edited(rng, one, rng.randrange(1 + len(one) // 40)))]
        if family % 2:
            texts.append(" ".join(base))
    rng.shuffle(texts)
    got, want = _roots(spark, texts), _expected(texts)
    assert len(set(want)) < len(texts)
    named = {}
    for i, w in enumerate(want):
        assert named.setdefault(w, got[i]) == got[i]
    assert len(set(named.values())) == len(named)


def test_shared_phrases_make_no_pairs(spark, monkeypatch):
    """Long texts, any two of which share a phrase and no more, aren't compared one by one."""
    asked = _counted(monkeypatch)
    rng = random.Random(3)
    texts = [[f"t{i}.{j}" for j in range(600)] for i in range(30)]
    for i, j in combinations(range(30), 2):
        phrase = [f"p{i}.{j}.{k}" for k in range(5)]
        for t in (i, j):
            at = rng.randrange(len(texts[t]))
            texts[t][at:at] = phrase
    got = _roots(spark, [" ".join(t) for t in texts])
    assert len(set(got.values())) == 30
    assert sum(asked) < 30


def test_a_large_family_is_joined_by_one_of_it(spark, monkeypatch):
    """Copies that are each near to one text make about as many comparisons as there are copies."""
    asked = _counted(monkeypatch)
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(500)]
    texts = [" ".join(base)] + [" ".join(_edited(rng, base, 9)) for _ in range(60)]
    assert len(set(_roots(spark, texts).values())) == 1 == len(set(_expected(texts)))
    assert sum(asked) < 61 * 9
