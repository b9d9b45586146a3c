"""The Katz model against a plain dictionary version on small texts."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from thalweg.llm import katz

DOCS = [
    (0, "the cat sat on the mat the cat ran"), (1, "the dog sat on the cat"), (2, "A cat and A dog and a Cat"), (3, ""), (4, None),
    (5, "the cat sat on the mat the cat ran"), (6, "unseen words only here\tand\nthere"), (7, "the the the the the the the the"), (None, "no id here the cat"),
    (8, "a b c d e f g h i j"), (8, "a b c d e f g h i j"), (9, "ÀÉ the Ω cat"), (11, "the cat sat"), (12, "the mat sat on a dog"), (13, "dog cat dog cat"),
]


def words(text):
    return [*(text or "").encode().lower().split(), None]


def plain(docs, order=2):
    """(word probability, probability after a history, N, V, counts) by dictionaries."""
    train = [words(t) for i, t in docs if i is None or crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for ws in train for w in ws)
    grams = {k: Counter(tuple(x[i : i + k]) for x in (["<s>", *ws] for ws in train) for i in range(len(x) - k + 1)) for k in range(2, order + 1)}
    n = sum(uni.values())
    stats = [n, len(uni), *(sum(c == r for c in uni.values()) for r in range(1, 7))]
    d = {k: katz.discounts([sum(c == r for c in g.values()) for r in range(1, 7)]) for k, g in grams.items()}
    low = lambda w: float(katz.words_probability(np.array([uni[w]]), stats)[0])

    def prob(history, w):
        history = tuple(history)
        if not history:
            return low(w)
        d_k = d[len(history) + 1]
        seen = {g[-1]: c for g, c in grams[len(history) + 1].items() if g[:-1] == history}
        total = sum(seen.values())
        used, mass = sum(d_k[min(c, 6)] * c for c in seen.values()), sum(prob(history[1:], x) for x in seen)
        alpha, scale = katz.context_weights(np.array([float(total)]), np.array([used]), np.array([mass]))
        return scale[0] * d_k[min(seen[w], 6)] * seen[w] / total if w in seen else alpha[0] * prob(history[1:], w)

    return low, prob, n, len(uni), uni


@pytest.mark.parametrize("block, shared, order", [(3, 64, 3), (3, 1, 3), (40, 64, 2), (40, 64, 4), (10**6, 64, 3)])
def test_scores_equal_plain_version(spark, monkeypatch, block, shared, order):
    monkeypatch.setattr(katz, "SHARED", shared)  # blocks whose bigrams of one word meet: with 1, as many parts as blocks
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in DOCS], "doc_id long, text string, train string, score double")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in katz.katz_scores(docs, block=block, order=order).collect())
    low, prob, n, v, uni = plain(DOCS, order)
    want = []
    for i, t in DOCS:
        ws = words(t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(prob(["<s>", *ws[:j]][-(order - 1) :], w)) for j, w in enumerate(ws))
        want.append((-1 if i is None else i, len(ws), sum(uni[w] > 0 for w in ws), n, round(base, 9), round(score, 9)))
    assert got == sorted(want)


def test_ngrams_of_a_context_that_one_block_has_are_not_sent(spark, monkeypatch):
    """op1's disk: of the longer n-grams only those go to a bucket whose context several blocks have; the others are counted where they are."""
    texts = [f"w{k} x{k} y{k} z{k} the cat sat v{k % 3} w{k}" for k in range(24)]
    sent, count = [], katz.count_grams

    def counted(requests, order, *rest):
        sent.append(sum(len(katz.unpack_many(r["grams"])[3]) for r in requests.collect()))
        return count(requests, order, *rest)

    monkeypatch.setattr(katz, "count_grams", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    assert katz.katz_scores(docs, block=10).count() == len(texts)  # a text a block
    grams = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in ([0, *t.split(), 1] for t in texts)]
    blocks_of = Counter(c for g in grams for c in {x[:2] for x in g})
    assert sent == [sum(blocks_of[x[:2]] > 1 for g in grams for x in g)]
    assert 0 < sent[0] < sum(map(len, grams)) / 2


@pytest.mark.parametrize("hot, order", [(1, 3), (2, 4), (3, 3)])
def test_sliced_contexts_keep_their_scores(spark, monkeypatch, hot, order):
    """op1's disk: messages go to a bucket each, however many blocks there are; a context that is seen often is dealt over several, and its slices' sums are added up."""
    parts, requests = set(), katz.gram_requests

    def asked(*args):
        out = requests(*args)
        parts.update(r["part"] for r in out.select("part").collect())
        return out

    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(1)
    ask = lambda: {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["score"], 9)) for r in katz.katz_scores(docs, block=3, order=order).collect()}
    want = ask()
    monkeypatch.setattr(katz, "gram_requests", asked)
    monkeypatch.setattr(katz, "SHARED", 1)
    monkeypatch.setattr(katz, "HOT", hot)
    assert ask() == want
    assert parts <= set(range(8))


def test_every_context_adds_up_to_one():
    low, prob, _, _, uni = plain(DOCS, 3)
    assert sum(low(w) for w in [*uni, b"never"]) == pytest.approx(1)
    single = [("<s>",), *[(w,) for w in uni if w], (b"never",)]
    for c in [*single, (b"the", b"cat"), ("<s>", b"the"), (b"sat", b"on"), (b"never", b"the")]:
        assert sum(prob(c, w) for w in [*uni, b"never"]) == pytest.approx(1), c


def test_empty_table_and_nothing_to_learn(spark):
    schema = "doc_id long, text string"
    assert katz.katz_scores(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    row = katz.katz_scores(spark.createDataFrame([(held, "some words")], schema)).first()
    assert (row["held_out"], row["train_tokens"], row["n_known"], row["base_score"], row["score"]) == (True, 0, 0, 0.0, 0.0)


def test_discounts_lie_between_zero_and_one():
    d = katz.discounts([1000, 400, 220, 140, 98, 72])
    assert all(0 < x <= 1 for x in d[1:]) and d[6] == 1 and d[1] < d[2] < d[3]
    assert (katz.discounts([0] * 6) == 1).all()
