"""Byte-level BPE and token alignment against the tokenizer libraries and plain versions."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from thalweg.llm import alignment, bytebpe, queries

tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.001"
BITS = ["'", "s", "t", "re", "ve", "ll", "d", " ", " ", "\n", "\t", " ", "a", "é", "Z", "1", "٣", "½", "!", "—", "😀", "中", " ", "'S", "m", "́", "<|endoftext|>"]
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "it's we'll 'tis"), (4, "it's we'll 'tis"), (None, "no id"), (5, "x" * 40000 + " " * 3000 + "word " * 20000), (6, "é Ω  don't'd''s"), (7, "<|endoftext|>")]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = bytebpe.vocabulary(PATH)
    ids, ends, cuts = words.encoded(np.frombuffer(b"".join(raw), np.uint8), bounds)
    for k, r in enumerate(raw):
        assert words.decoded(ids[cuts[k] : cuts[k + 1]], ends[cuts[k] : cuts[k + 1]]) == r
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@pytest.mark.parametrize("window, run", [(7, 5), (64, 1000), (1 << 20, 1 << 20)])
def test_random_texts_equal_the_library(monkeypatch, library, window, run):
    monkeypatch.setattr(bytebpe, "WINDOW", window)
    monkeypatch.setattr(bytebpe, "RUN", run)
    rnd = random.Random(window)
    for _ in range(60):
        texts = ["".join(rnd.choices(BITS, k=rnd.choice([0, 1, 2, 3, 5, 8, 20, 200]))) for _ in range(30)]
        assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_and_long_slices_equal_the_library(library):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points), "a".join(points[::7]), " ".join(points[1::7]), "a" * 5000 + " " * 3000 + "x", "ab" * 3000 + "!?" * 2000, "x" * 95, "x" * 96, "é" * 47 + "x" * 9]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_of_parts_equals_scan_of_whole():
    symbols = np.random.default_rng(3).integers(0, 16, 5000).astype(np.uint8)
    cuts, last = bytebpe.scan(symbols)
    state, parts = bytebpe.FRESH, []
    for a in range(0, 5000, 617):
        found, state = bytebpe.scan(symbols[a : a + 617], state)
        parts.append(found)
    assert (np.concatenate(parts) == cuts).all() and state == last


def check_digests(rows, texts, library):
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(want)


def test_query_equals_the_library(spark, library):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_digests(queries.op13_byte_bpe(spark, DATA).collect(), texts, library)


def test_odd_rows(spark, monkeypatch, library):
    monkeypatch.setattr(bytebpe, "CHUNK", 50)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, ids long, decoded string")
    check_digests(bytebpe.digests(docs, PATH).collect(), ODD, library)
    assert bytebpe.digests(docs.where("false"), PATH).count() == 0
    tokens = bytebpe.encode(docs.where("doc_id = 6"), PATH).first()
    assert tokens["ends"][-1] == len(ODD[-2][1].encode()) and len(tokens["ends"]) == len(tokens["ids"])
    wrong = spark.createDataFrame([([1, 2], [1, 9])], "ids array<int>, ends array<int>")
    with pytest.raises(Exception, match="offsets don't fit"):
        bytebpe.decode(wrong, PATH).collect()
    none = spark.createDataFrame([(None, None), ([], [])], "ids array<int>, ends array<int>")
    assert [bytes(r["decoded"]) for r in bytebpe.decode(none, PATH).collect()] == [b"", b""]


def plain_alignment(texts):
    """The eight columns of every text by one library call each and dictionaries."""
    a_path, b_path = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
    both, found, times = alignment.Pair(a_path, b_path), [], Counter()
    for doc_id, text in texts:
        a = both.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        joined = [b"".join(bytes(names[i]) for i in ids) for ids, names in ((a, both.a_bytes), (b, both.b_bytes))]
        if not text or joined != [f" {text}".encode()] * 2:
            a, b = [], []
        ends = [np.cumsum([len(names[i]) for i in ids], dtype=int).tolist() for ids, names in ((a, both.a_bytes), (b, both.b_bytes))]
        place = [{e: k for k, e in enumerate(x)} for x in ends]
        groups, links, x, y = [], [], 0, 0
        for e in ends[0]:
            if e in place[1]:
                i, j = place[0][e] + 1, place[1][e] + 1
                groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
                links.append((a[i - 1], b[j - 1]))
                x, y = i, j
        times.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = Counter()
    for (_, b), n in times.items():
        top[b] = max(top[b], n)
    return sorted((str(i), na, nb, g, len(ls), sum(times[x] == top[x[1]] for x in ls), sum(times[x] for x in ls), sha) for i, na, nb, g, ls, sha in found)


def digests_of(frame):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in frame.collect())


def test_alignment_equals_plain_version(spark, monkeypatch):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert digests_of(queries.op12_alignment(spark, DATA)) == plain_alignment(texts)


@pytest.mark.parametrize("common, words", [(10_000, True), (3, True), (10_000, False)])
def test_odd_alignments(spark, monkeypatch, common, words):
    monkeypatch.setattr(alignment, "COMMON", common)
    monkeypatch.setattr(alignment, "CHUNK", 60)
    rnd = random.Random(5)
    bits = [*BITS, "▁", "ﬁ", "<s>", "foo", "Å", "the ", "　"]
    texts = ODD + [(100 + k, "".join(rnd.choices(bits, k=rnd.choice([1, 2, 5, 20, 100])))) for k in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, links string, row int").repartition(2)
    paths = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
    if not words:  # whole texts in place of words
        both = alignment.Pair(*paths)
        both.words = False
        for k in (0, 5, 8, 40):
            data = np.frombuffer(f" {texts[k][1] or ''}".encode(), np.uint8)
            whole = alignment._chunk(both, data, np.array([0, len(data)]), np.array([not texts[k][1]]))
            both.words = True
            assert [c.to_pylist() for c in whole] == [c.to_pylist() for c in alignment._chunk(both, data, np.array([0, len(data)]), np.array([not texts[k][1]]))]
            both.words = False
        return
    assert digests_of(alignment.digests(docs, *paths)) == plain_alignment(texts)
    assert alignment.digests(docs.where("false"), *paths).count() == 0
