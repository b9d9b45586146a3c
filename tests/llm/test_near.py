"""Near-dedup of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import DATA, docs_of
from thalweg.llm import jaccard, simhash


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts):
    """The group of each text by links of Jaccard similarity 0.8 or more among all pairs, and the linked pairs."""
    sets = [sets_of(t) for t in texts]
    root, pairs = list(range(len(texts))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4 and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                pairs.append((b, a))
                root[find(a)] = find(b)
    return [find(i) for i in range(len(texts))], pairs


def near_copies():
    """Texts of 30 to 400 words with copies of similarity 0.75 to 0.97, copies of copies, and lines that many share."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [" ".join(word() for _ in range(14)) for _ in range(3)]
    texts = []
    for k in range(60):
        words = [word() for _ in range(rng.randrange(30, 400))]
        if k % 2:
            words += rng.choice(common).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = words if rng.random() < 0.5 else texts[-1].split()
            copy = list(words)
            for _ in range(max(1, round(len(copy) * rng.uniform(0.003, 0.03)))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def same(got, want):
    return len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


@pytest.mark.parametrize("common", [jaccard.COMMON, 1])
def test_links_are_those_of_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    texts = [*near_copies(), None, "", " \n", "one two three", "One TWO  three", "four"]
    want, pairs = groups_of(texts)
    assert len(pairs) > 30
    got = {r["doc_id"]: r["root"] for r in jaccard.grouped(docs_of(spark, list(enumerate(texts)))).collect()}
    assert same([got[k] for k in range(len(texts))], want)


def test_survivors_are_those_of_brute_force(spark):
    texts = near_copies()
    want, _ = groups_of(texts)
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(spark, list(enumerate(texts)))).collect())
    assert kept == sorted({w: k for k, w in reversed(list(enumerate(want)))}.values())


def test_real_texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want, _ = groups_of([t for _, t in rows])
    got = {r["doc_id"]: r["root"] for r in jaccard.grouped(docs_of(spark, rows)).collect()}
    assert same([got[i] for i, _ in rows], want)


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " end"), (7, c), (7, d), (7, d), (8, e), (None, e), (None, e + " end"), (9, c)]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(docs_of(spark, rows)).collect())
    assert [i for i, _ in kept] == ["7", "7", "8", "None", "None"]
    assert {t.removesuffix(" end") for _, t in kept} == {a, b, c, d, e}
    only = [(None, a), (1, b), (None, b)]  # a single group without an id
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(docs_of(spark, only)).collect()) == sorted([("None", a), ("1", b)])


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 6, 9])
def test_keys_of_the_whole_radius_meet(bits):
    rng = np.random.default_rng(bits)
    fps = rng.integers(-(2**63), 2**63, 500)
    other = fps.copy()
    for k in range(len(other)):
        for bit in rng.choice(64, bits, replace=False):
            other[k] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    one, two = (set(zip(*(x.tolist() for x in simhash.keys(f, bits)), strict=True)) for f in (fps, other))
    assert {owner for _, owner in one & two} == set(range(len(fps)))


def test_hot_keys_are_split_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    fps = {int(rng.integers(-(2**63), 2**63))}
    for f in list(fps) * 300 + [0] * 200:
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            f ^= 1 << int(bit)
        fps.add(f - (1 << 64) if f >= 1 << 63 else f)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(edges):
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in edges:
            root[find(a)] = find(b)
        return {f: find(f) for f in fps}

    whole = groups([tuple(r) for r in simhash.links(frame).collect()])
    monkeypatch.setattr(simhash, "HOT", 3)
    split = groups([tuple(r) for r in simhash.links(frame).collect()])
    ids = sorted(fps)
    assert same([whole[f] for f in ids], [split[f] for f in ids])


def test_sketches_never_rule_out_an_alike_pair():
    rng = np.random.default_rng(2)
    for n in (1, 5, 80, 70_000):
        base = np.unique(rng.integers(-(2**63), 2**63, n))
        other = np.unique(np.concatenate([base[: max(1, n * 9 // 10)], rng.integers(-(2**63), 2**63, n // 20)]))
        one, two = (np.frombuffer(jaccard.sketch(x), np.uint8) for x in (base, other))
        assert jaccard.in_common(one, two[None])[0] >= len(np.intersect1d(base, other))


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    want, _ = groups_of(texts)
    got = {r["doc_id"]: r["root"] for r in jaccard.grouped(docs_of(spark, list(enumerate(texts)))).collect()}
    assert same([got[k] for k in range(len(texts))], want)
