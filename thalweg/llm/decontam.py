"""Benchmark passages in documents, found by latent semantic retrieval and proved by subsequence and answer checks.

Documents are read as chunks of 32 words; a passage is two neighbouring
chunks. Passages and benchmark items are TF-IDF vectors over the words of the
benchmark, weighted by counts over all documents. A randomised SVD (a random
start, power iterations and orthogonalisation; the products with the
passage matrix are summed over partitions) gives a few latent directions, in
which each passage is compared with every item by cosine. Items that come near
are then proved on the words themselves: the longest common subsequence of the
item and the place around the passage must cover most of the item, or, for a
paraphrase, half of it together with two thirds of the item's answer, its
rarest words.

The benchmark is taken in blocks of ``BLOCK`` items, each with an index of its
own. One pass over the documents counts the words of all blocks, one draws the
sample that all blocks share, and one searches with all indexes at a time; only
beyond ``TOGETHER`` blocks there are more such passes, so what is sent to
executors is bounded however large the benchmark grows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import checkpointed

BLOCK, TOGETHER = 512, 32
CHUNK = 32
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: letters and digits, A-Z lower-cased, split at every other ASCII sign."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def subsequence(item: list[bytes], place: list[bytes]) -> int:
    """Length of the longest common subsequence, with the item's positions as the bits of one number."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in place:
        hit = row & at.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


@dataclass
class Index:
    """What executors need: the items, the word numbers and weights, the latent map of words and the items' directions."""

    ids: list[int]
    items: list[list[bytes]]
    number: dict[bytes, int]
    weight: np.ndarray
    latent: np.ndarray
    directions: np.ndarray

    def __post_init__(self) -> None:
        self.reach = max(map(len, self.items), default=0)
        self.counts = [Counter(ws) for ws in self.items]

    def possible(self, i: int, near: set[bytes], paraphrase: float) -> bool:
        """Whether the words around hold enough of the item's for any order of them to prove it."""
        counts = self.counts[i]
        return sum(counts[w] for w in counts.keys() & near) >= paraphrase * len(self.items[i])

    def answer(self, i: int, count: int = 3) -> set[bytes]:
        """The item's rarest words."""
        return set(sorted(set(self.items[i]), key=lambda w: (-self.weight[self.number[w]], w))[:count])

    def proved(self, i: int, place: list[bytes], cover: float, paraphrase: float) -> float:
        """Share of the item that the place covers in order, or 0 if that proves nothing."""
        item = self.items[i]
        if len(item) < 8:  # too short for a share to tell: only the whole item in one piece counts
            return float(any(place[k : k + len(item)] == item for k in range(len(place) - len(item) + 1)))
        share = subsequence(item, place) / len(item)
        answer = self.answer(i)
        if share >= cover or (share >= paraphrase and 3 * len(answer & set(place)) >= 2 * len(answer)):
            return share
        return 0.0


def _numbers(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    get = number.get
    return np.fromiter((get(w, -1) for w in words), np.int32, len(words))


def _passages(texts: list[list[bytes]], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of all passages of some texts, with the text and first word of each."""
    owner, first, rows, cols = [], [], [], []
    base = 0
    for t, words in enumerate(texts):
        n = max(1, -(-len(words) // CHUNK))
        ids = _numbers(words, index.number)
        at = np.flatnonzero((ids >= 0) & (index.weight[ids] > 0))
        rows.append(base + at // CHUNK)
        cols.append(ids[at])
        owner.append(np.full(n, t))
        first.append(np.arange(n) * CHUNK)
        base += n
    row, col = np.concatenate(rows), np.concatenate(cols)
    chunks = np.zeros((base, index.latent.shape[1]), np.float32)
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        chunks[row[starts]] = np.add.reduceat(index.latent[col], starts, axis=0)
    own = np.concatenate(owner)
    follows = np.zeros(base, bool)
    follows[:-1] = own[1:] == own[:-1]
    both = chunks.copy()
    both[:-1][follows[:-1]] += chunks[1:][follows[:-1]]
    return both, own, np.concatenate(first)


def find_all(texts: list[str | None], indexes: list[Index], cosine: float, cover: float, paraphrase: float) -> list[tuple[int, int, float, float]]:
    """As ``find``, with several indexes; no item is in two."""
    return [row for index in indexes for row in find(texts, index, cosine, cover, paraphrase)]


def find(texts: list[str | None], index: Index, cosine: float, cover: float, paraphrase: float) -> list[tuple[int, int, float, float]]:
    """``(text number, item id, cosine, share)`` of the items proved in each text, each item once."""
    words = [words_of(t) for t in texts]
    out: dict[tuple[int, int], tuple[float, float]] = {}
    group: list[int] = []

    def flush() -> None:
        vectors, owner, first = _passages([words[g] for g in group], index)
        lengths = np.linalg.norm(vectors, axis=1)
        live = np.flatnonzero(lengths > 1e-9)
        for at in range(0, len(live), 8192):
            rows = live[at : at + 8192]
            near = (vectors[rows] / lengths[rows, None]) @ index.directions.T
            last, around = -1, set()
            for r, i in zip(*(x.tolist() for x in np.nonzero(near >= cosine)), strict=True):
                t, start = group[owner[rows[r]]], int(first[rows[r]])
                key = (t, index.ids[i])
                if r != last:
                    last, around = r, set(words[t][max(0, start - index.reach) : start + 2 * CHUNK + index.reach])
                if not index.possible(i, around, paraphrase) or out.get(key, (0, 0))[1] >= 1.0:
                    continue
                reach = len(index.items[i])
                share = index.proved(i, words[t][max(0, start - reach) : start + 2 * CHUNK + reach], cover, paraphrase)
                if share > out.get(key, (0, 0.0))[1]:
                    out[key] = (float(near[r, i]), share)
        group.clear()

    size = 0
    for t, w in enumerate(words):
        if w:
            group.append(t)
            size += len(w)
        if size >= 200_000:
            flush()
            size = 0
    if group:
        flush()
    return [(t, i, c, s) for (t, i), (c, s) in sorted(out.items())]


def _word_counts(docs: DataFrame, number: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How often each benchmark word occurs in all documents, and how many words these have; one row a word reaches the driver."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(len(number) + 1, np.int64), 0
        for part in batches:
            for text in part.column("text"):
                words = words_of(text.as_py())
                total += len(words)
                sums += np.bincount(_numbers(words, number) + 1, minlength=len(number) + 1)
        sums[0] = total
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["word", "n"])

    rows = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(len(number) + 1, np.int64)
    for r in rows:
        sums[r["word"]] = r["n"]
    return sums[1:], int(sums[0])


def _directions(sample: DataFrame, base: np.ndarray, number: dict[bytes, int], weight: np.ndarray, width: int, rounds: int = 2) -> np.ndarray:
    """Orthonormal right singular directions (words x width) of the items ``base`` and the sampled passages, most telling first."""
    rng = np.random.default_rng(7)
    v, _ = np.linalg.qr(rng.standard_normal((len(number), width)).astype(np.float32))

    def products(v: np.ndarray) -> np.ndarray:
        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index([], [], number, weight, (v * weight[:, None]).astype(np.float32), np.zeros((0, v.shape[1])))
            out = np.zeros(v.shape, np.float64)
            for part in batches:
                for text in part["text"]:
                    words = words_of(text)
                    if not words:
                        continue
                    vectors, _, first = _passages([words], index)
                    ids = _numbers(words, number)
                    for shift in (0, -1):  # a chunk's words are in the passage it begins and in the one before
                        at = np.flatnonzero(ids >= 0)
                        passage = at // CHUNK + shift
                        at, passage = at[passage >= 0], passage[passage >= 0]
                        if len(at):
                            order = np.argsort(ids[at], kind="stable")
                            word = ids[at][order]
                            starts = np.flatnonzero(np.diff(word, prepend=-1))
                            out[word[starts]] += weight[word[starts], None] * np.add.reduceat(vectors[passage[order]], starts, axis=0)
            for k in range(0, len(out), 256):
                yield pd.DataFrame({"slot": [k], "part": [out[k : k + 256].ravel()]})

        def joined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"slot": [key[0]], "part": [np.sum(np.stack(parts["part"].to_list()), axis=0)]})

        schema = "slot int, part array<double>"
        rows = sample.mapInPandas(summed, schema).groupBy("slot").applyInPandas(joined, schema).collect()
        out = np.zeros(v.shape)
        for r in rows:
            block = np.array(r["part"]).reshape(-1, v.shape[1])
            out[r["slot"] : r["slot"] + len(block)] = block
        return out + base.T @ (base @ v)

    for _ in range(rounds):
        v, _ = np.linalg.qr(products(v))
    values, turn = np.linalg.eigh(v.T @ products(v))
    return v @ turn[:, np.argsort(-values)]


def build(sample: DataFrame, kept: list[tuple[int, list[bytes]]], totals: dict[bytes, int], total: int, *, width: int = 128) -> Index:
    """The index of one block of items. Counts are of all documents, the SVD of a bounded sample of them."""
    number = {w: k for k, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
    counts = np.array([totals[w] for w in number], dtype=np.int64)
    # Squared, so that rare words decide; words in every passage or more weigh nothing.
    weight = (np.log(np.maximum(1.0, (total + 1) / (CHUNK * (counts + 1.0)))) ** 2).astype(np.float32)
    base = np.zeros((len(kept), len(number)), np.float32)
    for r, (_, ws) in enumerate(kept):
        for w in ws:
            base[r, number[w]] += weight[number[w]]
    width = min(width, len(number))
    v = _directions(sample, base, number, weight, width)
    spots = base @ v
    lengths = np.linalg.norm(spots, axis=1, keepdims=True)
    return Index([i for i, _ in kept], [ws for _, ws in kept], number, weight, (v * weight[:, None]).astype(np.float32), (spots / np.maximum(lengths, 1e-9)).astype(np.float32))


def sampled(docs: DataFrame, sample_docs: int = 400) -> DataFrame:
    """About ``sample_docs`` documents, those whose hash is below a threshold; repeated rows count once."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("doc_id", "text").alias("h"))
    chosen = rows.where(F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).dropDuplicates(["h"]).select("text")
    return checkpointed(chosen.repartition(8))


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Index]]:
    """The benchmark's blocks as indexes, up to TOGETHER at a time; only so many items reach the driver at once. Items without id or words are left out."""
    parts = -(-benchmark.count() // BLOCK)
    sample = None
    for at in range(0, parts, TOGETHER):
        mine = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")).where(F.col("part").between(at, min(at + TOGETHER, parts) - 1))
        dealt: dict[int, list[tuple[int, list[bytes]]]] = {}
        for r in mine.toLocalIterator():
            if r["item_id"] is not None and (w := words_of(r["text"])):
                dealt.setdefault(r["part"], []).append((r["item_id"], w))
        if not dealt:
            continue
        number = {w: k for k, w in enumerate(sorted({w for kept in dealt.values() for _, ws in kept for w in ws}))}
        counts, total = _word_counts(docs, number)
        sample = sampled(docs) if sample is None else sample
        totals = dict(zip(number, counts.tolist(), strict=True))
        yield [build(sample, sorted(kept), totals, total) for _, kept in sorted(dealt.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.4, cover: float = 0.8, paraphrase: float = 0.5) -> DataFrame:
    """``(doc_id, item_id, cosine, share)`` of every benchmark item found in a document, each pair once.

    Null or empty texts hold nothing, items without words are never found,
    repeated rows are each searched, other columns are ignored, and an empty
    benchmark finds nothing.
    """
    out = None
    schema = "doc_id long, item_id long, cosine double, share double"
    for group in indexes(docs, benchmark):

        def searched(batches: Iterator[pa.RecordBatch], group: list[Index] = group) -> Iterator[pa.RecordBatch]:
            for part in batches:
                ids, found = part.column("doc_id").to_pylist(), find_all(part.column("text").to_pylist(), group, cosine, cover, paraphrase)
                cols = [[ids[t] for t, *_ in found], [i for _, i, *_ in found], [c for *_, c, _ in found], [s for *_, s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "cosine", "share"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(searched, schema)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.4, cover: float = 0.8, paraphrase: float = 0.5) -> DataFrame:
    """``docs`` without the rows in which an item is found; their columns and whole texts are kept.

    Null and empty texts stay, repeated rows stay or go together, and an empty
    benchmark leaves all.
    """
    out = docs
    for group in indexes(docs, benchmark):

        def cleaned(batches: Iterator[pa.RecordBatch], group: list[Index] = group) -> Iterator[pa.RecordBatch]:
            at = None
            for part in batches:
                at = part.schema.get_field_index("text") if at is None else at
                bad = {t for t, *_ in find_all(part.column(at).to_pylist(), group, cosine, cover, paraphrase)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(cleaned, docs.schema)
    return out
