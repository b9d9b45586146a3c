"""A Katz back-off language model over words: trained, stored and applied as tables of packed arrays.

N-grams of up to ``ORDER`` words back off to those one word shorter, single
words to one class of unknown words. A text begins with one START mark, and a
word with fewer words before it than a context takes has the shorter one's probability.
Counts up to ``CUTOFF`` are discounted as Good and Turing have it; the mass
that a context's discounts free is shared out over the words not seen after it
in proportion to their lower-order probability, so every context's
probabilities, that of the unknown class included, add up to one.

Texts are tokenised once, into blocks of about ``BLOCK`` tokens that carry
their own sorted vocabulary. Everything after that moves packed arrays:

1. words: each block sends its vocabulary, by slices of the hash range, to the
   table of word counts; it gets back a number and the count of each word;
2. bigrams: each block sends its distinct bigrams once, to the bucket of the
   second word (split further by a hash of the first, into more parts the more
   blocks there are, so a word that ends a large part of all bigrams is spread
   out and no part grows with the corpus); it gets back their counts;
3. contexts: the bigram table sends sums per context, to the bucket of the
   context's word; a block gets back the back-off weight of each of its words;
4. longer n-grams, length by length: each block sends its distinct ones once,
   to the bucket of their context, with what the shorter probability is made
   of, and gets back counts and weights. A context seen more than ``HOT`` times
   is dealt over the next buckets by a hash of the last word, into slices of
   about that many; only the sums of its slices are added up over buckets;
5. scores: each block works its tokens' probabilities out, length by length,
   from what it got back.

An n-gram that is everywhere is sent once a block, whatever its count. One whose
context no other block has isn't sent: the block knows all that follows it. All
tables lie in the shared folder, dealt by bucket. No table is ever collected
or broadcast, but for a few counts of counts and the sums of sliced contexts,
of which there are fewer than two times ``SLICED``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import drop, held_out, release, table

BLOCK = 1_000_000  # tokens
SLICE = 1_000_000  # vocabulary entries, over all blocks, for one bucket of words
SPREAD = 4  # parts of a bucket of bigrams, at least
SHARED = 64  # blocks, at most, whose bigrams of one word meet in a part of its bucket
PART = 1_500_000  # tokens, over all blocks, for one bucket of contexts of n-grams of three words and more
HOT = 250_000  # training tokens in a slice of such a context
SLICED = 32_768  # contexts, at most, that are sliced; in more than HOT times as many tokens slices are larger
ORDER = 3
CUTOFF = 5
END, START = b"\n", b"\r"  # not words: neither can come out of a split at white space


def pack(values: np.ndarray, dtype: str, level: int = 5) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values, dtype=dtype).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def pack_planes(values: np.ndarray, width: int = 4, level: int = 5) -> bytes:
    """Small whole numbers, byte by byte of their places, which leaves long runs of zeros."""
    planes = np.ascontiguousarray(values, dtype=f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pack(planes, "u1", level)


def unpack_planes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, "u1").reshape(width, -1).T).view(f"<u{width}").ravel()


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """Tokenised ``docs(doc_id, text, train)``: per block the documents' ids, marks and lengths, token numbers and the hashes they stand for.

    The commonest word has number 0; ``order`` lists the numbers by hash, which
    is how buckets of the hash range are sent and answered. Every block knows START.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        names = ["block", "held", "ids", "known", "train", "sizes", "tokens", "start", "order", "hashes"]
        made = TaskContext.get().partitionId() << 32

        def emit() -> pa.RecordBatch:
            words = list(number)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
            order = np.argsort(-np.bincount(np.concatenate(parts), minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            row = [
                made, held, pack([i or 0 for i in ids], "i8"), pack([i is not None for i in ids], "u1"), pack(train, "u1"),
                pack(sizes, "u4"), pack_planes(place[np.concatenate(parts)]), int(place[0]), pack_planes(np.argsort(hashes[order])), pack(hashes[order], "u8"),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

        number, ids, train, sizes, parts, held = _Numbers(), [], [], [], [], 0
        for part in batches:
            for doc_id, text, learns in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("train").to_pylist(), strict=True):
                if not ids:
                    number[START], number[END] = 0, 1
                words = tokens(text.as_py())
                words.append(END)
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                train.append(learns)
                sizes.append(len(words))
                held += len(words)
                if held >= size:
                    yield emit()
                    made += 1
                    number, ids, train, sizes, parts, held = _Numbers(), [], [], [], [], 0
        if ids:
            yield emit()

    return docs.mapInArrow(cut, "block long, held long, ids binary, known binary, train binary, sizes binary, tokens binary, start long, order binary, hashes binary")


def _train_tokens(train: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(train.astype(bool), sizes)


def word_requests(cut: DataFrame, buckets: int) -> DataFrame:
    """Per bucket and block, the hashes of the block's words in that part of the hash range, and their training counts (for START: training documents)."""
    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = _start_hash()
        for part in batches:
            for row in part.itertuples():
                hashes, train, sizes = unpack(row.hashes, "u8"), unpack(row.train, "u1"), unpack(row.sizes, "u4")
                counts = np.bincount(unpack_planes(row.tokens)[_train_tokens(train, sizes)], minlength=len(hashes))
                counts[hashes == start] = int(train.sum())
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order]
                edges = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
                some = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pd.DataFrame({
                    "bucket": some, "block": row.block,
                    "hashes": [pack(hashes[edges[b] : edges[b + 1]], "u8") for b in some],
                    "counts": [pack(counts[edges[b] : edges[b + 1]], "u8") for b in some],
                })

    return cut.select("block", "train", "sizes", "tokens", "hashes").mapInPandas(sent, "bucket int, block long, hashes binary, counts binary")


def _start_hash() -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(START))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` equal parts of the hash range; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def count_words(requests: DataFrame, buckets: int) -> DataFrame:
    """The word table. Rows with a block give that block's words their numbers and counts; the row without one holds the bucket's
    counts by rank and, in ``stats``, tokens, types and counts of counts. A word's number is its rank in the bucket, the commonest first, times ``buckets``, plus the bucket."""
    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack(h, "u8") for h in part["hashes"]]
        every, rank = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(rank, weights=np.concatenate([unpack(c, "u8") for c in part["counts"]]), minlength=len(every)).astype(np.int64)
        plain = counts[every != _start_hash()]
        falling = np.argsort(-counts, kind="stable")
        ranked = np.empty_like(falling)
        ranked[falling] = np.arange(len(falling))
        counts, rank = counts[falling], ranked[rank]
        stats = [int(plain.sum()), int((plain > 0).sum()), *(int((plain == r).sum()) for r in range(1, CUTOFF + 2))]
        out, at = [(key[0], None, None, pack_planes(counts, 8), stats)], 0
        for block, h in zip(part["block"], hashes, strict=True):
            mine = rank[at : at + len(h)]
            out.append((key[0], block, pack_planes(mine), pack_planes(counts[mine], 8), None))
            at += len(h)
        return pd.DataFrame(out, columns=["bucket", "block", "ranks", "counts", "stats"]).astype({"block": "Int64"})

    return requests.groupBy("bucket").applyInPandas(merged, "bucket int, block long, ranks binary, counts binary, stats array<long>")


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Katz's discount of each count up to CUTOFF, from how many types have counts 1 to CUTOFF + 1; 1 beyond.

    Where the counts of counts are too thin for a discount between 0 and 1,
    that count keeps its whole weight.
    """
    n = [0, *counts_of_counts]
    out = np.ones(CUTOFF + 2)
    if n[1]:
        top = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        for r in range(1, CUTOFF + 1):
            if n[r] and top < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
                if 0 < d < 1:
                    out[r] = d
    return out


def words_probability(counts: np.ndarray, stats: list[int]) -> np.ndarray:
    """Probability of a word of each count; a count of zero stands for the whole class of unknown words."""
    total, types, *spread = stats
    if not total:
        return np.ones(len(counts))
    d = discounts(spread)
    kept = (total - sum(n * r * (1 - d[r]) for r, n in enumerate(spread[:CUTOFF], 1))) / total
    scale = 1.0 if kept < 1 - 0.5 / (total + 1) else (total / (total + 1)) / kept
    return np.where(counts > 0, scale * d[np.minimum(counts, CUTOFF + 1)] * counts / total, 1 - scale * kept)


def _spread(order: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """What the buckets sent back, in ``order`` of the block's own numbers, by these numbers."""
    out = np.concatenate(parts)
    back = np.empty_like(out)
    back[order] = out
    return back


def numbered(joined: DataFrame, buckets: int) -> DataFrame:
    """Blocks with number and training count of each of their words, so that hashes and the word table aren't asked again."""
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                got, order = sorted(row.words, key=lambda w: w["bucket"]), unpack_planes(row.order)
                number = _spread(order, [unpack_planes(w["ranks"]).astype(np.int64) * buckets + w["bucket"] for w in got])
                counts = _spread(order, [unpack_planes(w["counts"], 8).astype(np.int64) for w in got])
                yield pd.DataFrame({
                    "block": [row.block], "ids": [row.ids], "known": [row.known], "train": [row.train], "sizes": [row.sizes], "tokens": [row.tokens], "start": [row.start],
                    "words": [pack_many([number, counts])],
                })

    return joined.mapInPandas(held, NUMBERED)


NUMBERED = "block long, ids binary, known binary, train binary, sizes binary, tokens binary, start long, words binary"


def _bigrams(row, number: np.ndarray, buckets: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct bigrams in the order they are sent: local numbers of context and word, bucket part, how often in
    training, and for each token the place of its bigram."""
    tok, sizes, many = unpack_planes(row.tokens).astype(np.int64), unpack(row.sizes, "u4"), len(number)
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[np.cumsum(sizes) - sizes] = row.start
    keys, place = np.unique(before * many + tok, return_inverse=True)
    context, word = keys // many, keys % many
    times = np.bincount(place[_train_tokens(unpack(row.train, "u1"), sizes)], minlength=len(keys))
    part = (number[word] % buckets) * spread + _mixed(number[context], spread)
    order = _order(number[context], number[word])
    order = order[np.argsort(part[order], kind="stable")]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return context[order], word[order], part[order], times[order], back[place]


def _order(*columns: np.ndarray) -> np.ndarray:
    """Sorts rows of whole numbers from 0 up by the last column, then the one before, as ``np.lexsort`` does, but two columns that
    fit in one number by that, which takes a third of the time; equal rows come in any order."""
    if len(columns) == 2 and len(columns[0]) and max(c.max() for c in columns) < 1 << 31:
        return np.argsort(columns[1].astype(np.int64) << 32 | columns[0].astype(np.int64))
    return np.lexsort(columns)


def _mixed(numbers: np.ndarray, spread: int | np.ndarray) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % spread


def bigram_requests(known: DataFrame, buckets: int, spread: int = SPREAD) -> DataFrame:
    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                number, _ = unpack_many(row.words)
                context, word, where, times, _ = _bigrams(row, number, buckets, spread)
                edges = np.flatnonzero(np.diff(where, prepend=-1))
                ends = [*edges[1:].tolist(), len(where)]
                rank = number[word] // buckets
                yield pd.DataFrame({
                    "part": where[edges], "block": row.block,
                    "contexts": [pack_planes(number[context[a:b]], 8) for a, b in zip(edges, ends, strict=True)],
                    "ranks": [pack_planes(np.diff(rank[a:b], prepend=0)) for a, b in zip(edges, ends, strict=True)],
                    "times": [pack_planes(times[a:b]) for a, b in zip(edges, ends, strict=True)],
                })

    return known.select("block", "train", "sizes", "tokens", "start", "words").mapInPandas(sent, "part int, block long, contexts binary, ranks binary, times binary")


def count_bigrams(requests: DataFrame) -> DataFrame:
    """The bigram table. Rows with a block give that block's bigrams their training counts, in the order it sent them, doubled, and one more for those that no other block sent; the row
    without one holds the part's seen bigrams (context numbers, word ranks, counts) and counts of counts."""
    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        contexts = [unpack_planes(c, 8).astype(np.int64) for c in part["contexts"]]
        ranks = np.concatenate([np.cumsum(unpack_planes(r).astype(np.int64)) for r in part["ranks"]])
        every = np.concatenate(contexts)
        order = _order(every, ranks)
        fresh = np.concatenate([[True], (np.diff(ranks[order]) != 0) | (np.diff(every[order]) != 0)])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        times = np.bincount(place, weights=np.concatenate([unpack_planes(t) for t in part["times"]])).astype(np.int64)
        first = order[fresh]
        seen, told = times > 0, times * 2 + (np.bincount(place) == 1)
        stats = [int((times == r).sum()) for r in range(1, CUTOFF + 2)]
        out, at = [(key[0], None, pack_planes(times[seen]), pack_planes(every[first][seen], 8), pack_planes(np.diff(ranks[first][seen], prepend=0)), stats)], 0
        for block, c in zip(part["block"], contexts, strict=True):
            out.append((key[0], block, pack_planes(told[place[at : at + len(c)]], 8), None, None, None))
            at += len(c)
        return pd.DataFrame(out, columns=["part", "block", "times", "contexts", "ranks", "stats"]).astype({"block": "Int64"})

    return requests.groupBy("part").applyInPandas(merged, "part int, block long, times binary, contexts binary, ranks binary, stats array<long>")


def context_sums(bigrams: DataFrame, words: DataFrame, buckets: int, stats: list[int], d: np.ndarray, spread: int = SPREAD) -> DataFrame:
    """Per bucket of contexts, from each part of the bigram table: discounted counts and lower-order mass of the words seen after each."""
    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            low = words_probability(unpack_planes(right["counts"].iloc[0], 8).astype(np.int64), stats)
            for row in left.itertuples():
                contexts, times = unpack_planes(row.contexts, 8).astype(np.int64), unpack_planes(row.times).astype(np.int64)
                mass = low[np.cumsum(unpack_planes(row.ranks).astype(np.int64))]
                every, place = np.unique(contexts, return_inverse=True)
                used = np.bincount(place, weights=d[np.minimum(times, CUTOFF + 1)] * times, minlength=len(every))
                mass = np.bincount(place, weights=mass, minlength=len(every))
                bucket = every % buckets
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    out.append((b, pack_planes(np.diff(every[mine] // buckets, prepend=0)), pack(used[mine], "f8"), pack(mass[mine], "f8")))
        return pd.DataFrame(out, columns=["bucket", "ranks", "used", "mass"])

    seen = bigrams.where("block IS NULL").select("part", F.floor(F.col("part") / spread).cast("int").alias("bucket"), "contexts", "ranks", "times")
    counts = words.where("block IS NULL").select("bucket", "counts")
    # A bucket of words meets its own counts; the parts of a bucket are rows of a few megabytes each.
    return seen.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(summed, "bucket int, ranks binary, used binary, mass binary")


def backoff_weights(sums: DataFrame, words: DataFrame) -> DataFrame:
    """The context table: per block and bucket, the back-off weight and the scale of seen words for each of the block's words as a context, by rank."""
    def weighed(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = right[right["block"].isna()]
        counts = unpack_planes(own["counts"].iloc[0], 8).astype(float)
        used, mass = np.zeros(len(counts)), np.zeros(len(counts))
        for row in left.itertuples():
            ranks = np.cumsum(unpack_planes(row.ranks).astype(np.int64))
            used[ranks] += unpack(row.used, "f8")
            mass[ranks] += unpack(row.mass, "f8")
        alpha, scale = context_weights(counts, used, mass)
        out = []
        for row in right[right["block"].notna()].itertuples():
            mine = np.sort(unpack_planes(row.ranks))
            out.append((int(row.block), key[0], pack_planes(alpha[mine].view("<u8"), 8), pack_planes(scale[mine].view("<u8"), 8)))
        return pd.DataFrame(out, columns=["block", "bucket", "alpha", "scale"])

    return sums.groupBy("bucket").cogroup(words.select("bucket", "block", "ranks", "counts").groupBy("bucket")).applyInPandas(weighed, "block long, bucket int, alpha binary, scale binary")


def context_weights(counts: np.ndarray, used: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back-off weight and scale of seen words of contexts seen ``counts`` times, whose seen words have discounted counts ``used`` and lower-order ``mass``.

    A context whose counts no discount touches gives its unseen words the
    share that one more occurrence would have. An unseen context backs off with weight one.
    """
    n = np.maximum(counts, 1)
    kept = np.where(counts > 0, used / n, 0.0)
    thin = (counts > 0) & (1 - kept < 0.5 / (n + 1))
    scale = np.where(thin, (n / (n + 1)) / np.where(kept > 0, kept, 1.0), 1.0)
    return np.where(counts > 0, (1 - scale * kept) / np.maximum(1 - mass, 1e-300), 1.0), scale


def pack_many(arrays: list[np.ndarray]) -> bytes:
    """Arrays of eight bytes a value as one packed value."""
    planes = [np.ascontiguousarray(x).view("<u8").view(np.uint8).reshape(-1, 8).T.ravel() for x in arrays]
    return pack(np.concatenate([np.array([len(arrays), *map(len, arrays)], "<u8").view(np.uint8), *planes]), "u1")


def unpack_many(data: bytes) -> list[np.ndarray]:
    """Whole numbers; ``view`` those that are fractions."""
    raw = unpack(data, "u1")
    many = int(raw[:8].view("<u8")[0])
    sizes = raw[8 : 8 * (many + 1)].view("<u8").astype(np.int64)
    ends = 8 * (many + 1 + np.cumsum(sizes))
    return [np.ascontiguousarray(raw[e - 8 * n : e].reshape(8, -1).T).view("<i8").ravel() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _first_levels(joined: DataFrame, buckets: int, spread: int) -> DataFrame:
    """Blocks that hold all that is known of their words and bigrams, so that the tables before aren't asked again."""
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                number, _ = unpack_many(row.words)
                *_, place = _bigrams(row, number, buckets, spread)
                got, order = sorted(row.weights, key=lambda w: w["bucket"]), np.lexsort((number, number % buckets))
                alpha, scale = (_spread(order, [unpack_planes(w[k], 8).view("<f8") for w in got]) for k in ("alpha", "scale"))
                sent = np.concatenate([unpack_planes(t["times"], 8) for t in sorted(row.bigrams, key=lambda t: t["part"])]).astype(np.int64)
                tok, sizes = unpack_planes(row.tokens).astype(np.int64), unpack(row.sizes, "u4").astype(np.int64)
                history = _Grams(tok, sizes, row.start, len(number), 2)
                token = np.cumsum(history.plain) - 1
                times = sent[place[token[history.levels[0][1]]]]
                yield pd.DataFrame({
                    "block": [row.block], "ids": [row.ids], "known": [row.known], "train": [row.train], "sizes": [row.sizes], "tokens": [row.tokens], "start": [row.start],
                    "words": [row.words], "levels": [[pack_many([times >> 1, number[:0], scale, alpha, times & 1])]],
                })

    return joined.mapInPandas(held, STATE)


STATE = f"{NUMBERED}, levels array<binary>"


class _Grams:
    """A block's texts, each led by START, and their distinct n-grams of every length from 2 to ``order``.

    ``levels[k - 2]`` holds the places that end an n-gram of length k, one such
    place for each distinct n-gram, its context and its suffix (numbers of
    distinct n-grams one shorter), and for every place its n-gram's number.
    """

    def __init__(self, tok: np.ndarray, sizes: np.ndarray, start: int, many: int, order: int) -> None:
        ends = np.cumsum(sizes + 1)
        self.starts = ends - sizes - 1
        self.plain = np.ones(len(tok) + len(sizes), bool)
        self.plain[self.starts] = False
        self.text = np.full(len(self.plain), start, np.int32)
        self.text[self.plain] = tok
        depth = np.arange(len(self.text), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), sizes + 1)
        self.levels, place, self.many = [], self.text, [many]
        for k in range(2, order + 1):
            at = np.flatnonzero(depth >= k - 1).astype(np.int32)
            every, which = np.unique(place[at - 1].astype(np.int64) * many + self.text[at], return_inverse=True)
            first = np.empty(len(every), np.int64)
            first[which] = np.arange(len(which))
            ending, longer = at[first], np.full(len(self.text), -1, np.int32)
            longer[at] = which
            self.levels.append((at, ending, place[ending - 1], place[ending], longer))
            self.many.append(len(ending))
            place = longer


def _grams(row, order: int) -> tuple[_Grams, np.ndarray, np.ndarray]:
    number, counts = unpack_many(row.words)
    sizes = unpack(row.sizes, "u4").astype(np.int64)
    return _Grams(unpack_planes(row.tokens).astype(np.int64), sizes, row.start, len(number), order), number, counts


def _level(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of a block's n-grams of length ``k``; totals, scales and back-off weights of their contexts; which n-grams no other block has."""
    times, totals, scale, alpha, alone = unpack_many(row.levels[k - 2])
    if k == 2:  # a word's total is its count
        totals = unpack_many(row.words)[1]
    return times, totals, scale.view("<f8"), alpha.view("<f8"), alone > 0


def _own(row, grams: _Grams, order: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """How often the block's n-grams of length ``order`` are in its own training texts, which have a context that no other block has, into
    how many slices their contexts are dealt (all blocks know the same count), and what their suffixes' probability is made of: the
    suffix's count, total and scale of its context."""
    at, _, context, suffix, longer = grams.levels[order - 2]
    learns = np.zeros(len(grams.text), bool)
    learns[grams.plain] = _train_tokens(unpack(row.train, "u1"), unpack(row.sizes, "u4"))
    short, totals, scale, _, alone = _level(row, order - 1)
    below = grams.levels[order - 3][2][suffix]  # contexts of the suffixes
    return np.bincount(longer[at][learns[at]], minlength=grams.many[order - 1]), alone[context], 1 + short[context] // hot, (short[suffix], totals[below], scale[below])


def _lower(short: np.ndarray, totals: np.ndarray, scale: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probability of suffixes that were seen, 0 for others."""
    return scale / np.maximum(totals, 1) * below[np.minimum(short, CUTOFF + 1)] * short


def _messages(grams: _Grams, number: np.ndarray, order: int, buckets: int, alone: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The order in which a block's n-grams of a length are sent, their parts, numbers of the words of each, the newest first, and where a part begins.

    A part is a bucket of contexts, a slice of a common one being dealt to a later bucket; n-grams of one context stay together in it. Those whose context is ``alone`` stay here."""
    shared = np.flatnonzero(~alone)
    ending = grams.levels[order - 2][1][shared]
    words = [number[grams.text[ending - j]] for j in range(order)]
    mixed = np.zeros(len(ending), np.uint64)
    for column in words[1:]:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    part = ((_bucket(mixed, buckets).astype(np.int64) + _mixed(words[0], slices[shared])) % buckets).astype(np.int32)
    sent = np.argsort(part, kind="stable")
    part = part[sent]
    return shared[sent], part, [w[sent] for w in words], np.flatnonzero(np.diff(part, prepend=-1))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of columns differ from the row before."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def gram_requests(state: DataFrame, order: int, buckets: int, hot: int) -> DataFrame:
    """Per part and block, the block's distinct n-grams of length ``order`` with their training counts, and what the probability of
    each one's suffix is made of: the suffix's count, and for each context the total and scale of the context one shorter, and whether it
    is sliced. Those whose context no other block has only send how many of them have each count."""
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                grams, number, _ = _grams(row, order)
                many = grams.many[order - 1]
                if not many:
                    continue
                context = grams.levels[order - 2][2]
                times, alone, slices, suffixes = _own(row, grams, order, hot)
                own = [int((times[alone] == r).sum()) for r in range(1, CUTOFF + 2)]
                sent, part, words, edges = _messages(grams, number, order, buckets, alone, slices)
                times, context, sliced = times[sent], context[sent], (slices[sent] > 1).astype(np.int64)
                short, totals, scale = (x[sent] for x in suffixes)
                del grams, suffixes
                out = []
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)][: len(edges)], strict=True):
                    first = np.flatnonzero(_runs(context[a:b])) + a
                    out.append((int(part[a]), row.block, pack_many([np.diff(first, append=b), totals[first], scale[first], words[0][a:b], times[a:b], short[a:b], sliced[first], *(w[first] for w in words[1:])]), None))
                # What the block counts by itself goes with its first message, an empty one if it has none.
                out[:1] = [(*out[0][:3], own) if out else (row.block % buckets, row.block, pack_many([np.zeros(0, np.int64)] * (order + 6)), own)]
                yield pd.DataFrame(out, columns=["part", "block", "grams", "own"])

    return state.mapInPandas(asked, "part int, block long, grams binary, own array<long>")


def count_grams(requests: DataFrame, order: int, below: np.ndarray) -> DataFrame:
    """The table of n-grams of length ``order``, a row a part: totals of its contexts, lower-order mass of the words seen after each and
    how many of these have counts 1 to CUTOFF; counts of counts; for each block the counts of its n-grams (doubled, and one more where no other block has it), ranks of its
    contexts and which of these have a word that was never seen. Of sliced contexts the ranks and words come along."""
    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        got = [unpack_many(g) for g in part["grams"]]
        fan, totals, scale, word, times, short, sliced, *context = (np.concatenate(c) for c in zip(*got, strict=True))
        order_c = _order(*context[::-1])
        fresh = _runs(*(c[order_c] for c in context))
        rank = np.empty(len(order_c), np.int64)
        rank[order_c] = np.cumsum(fresh) - 1
        owner = np.repeat(rank, fan)
        order_g = _order(word, owner)
        new = _runs(owner[order_g], word[order_g])
        place = np.empty(len(order_g), np.int64)
        place[order_g] = np.cumsum(new) - 1
        sums = np.bincount(place, weights=times).astype(np.int64)
        first = order_g[new]
        low = _lower(short[first], np.repeat(totals, fan)[first], np.repeat(scale.view("<f8"), fan)[first], below)
        told = sums * 2 + (np.bincount(place) == 1)
        mine, many = owner[order_g[new]], int(fresh.sum())
        by_context = lambda weights: np.bincount(mine, weights=weights, minlength=many)
        model = [by_context(sums).astype(np.int64), by_context(low * (sums > 0)), *(by_context(sums == r).astype(np.int64) for r in range(1, CUTOFF + 1))]
        blocks, c, g = [], 0, 0
        for block, (f, *_) in zip(part["block"].tolist(), got, strict=True):
            n = int(f.sum())
            counts = told[place[g : g + n]]
            open_ = np.bincount(np.repeat(np.arange(len(f)), f), weights=counts < 2, minlength=len(f)) > 0
            blocks.append({"block": block, "data": pack_many([counts, rank[c : c + len(f)], open_.astype(np.int64)])})
            c, g = c + len(f), g + n
        own = [o for o in part["own"] if o is not None]
        stats = [int((sums == r).sum()) + int(sum(o[r - 1] for o in own)) for r in range(1, CUTOFF + 2)]
        which = np.flatnonzero(sliced[order_c[fresh]])
        return pd.DataFrame({"part": [key[0]], "sums": [pack_many(model)], "sliced": [pack_many([which, *(c[order_c[fresh]][which] for c in context)]) if len(which) else None], "stats": [stats], "blocks": [blocks]})

    return requests.groupBy("part").applyInPandas(merged, "part int, sums binary, sliced binary, stats array<long>, blocks array<struct<block: bigint, data: binary>>")


def add_slices(counted: DataFrame) -> DataFrame:
    """Per part, its sliced contexts by rank with their ``sums`` over all parts: total, lower-order mass and how many words have counts 1 to CUTOFF."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                (which, *context), (totals, mass, *counts_of) = unpack_many(row.sliced), unpack_many(row.sums)
                sums = [totals, mass.view("<f8"), *counts_of]
                yield pd.DataFrame({"part": row.part, "rank": which, "context": list(np.column_stack(context)), "sums": list(np.column_stack([x[which].astype(float) for x in sums]))})

    slices = counted.where("sliced IS NOT NULL").select("part", "sliced", "sums").mapInPandas(listed, "part int, rank long, context array<long>, sums array<double>")
    added = F.array(*[F.sum(F.col("sums")[i]).over(Window.partitionBy("context")) for i in range(CUTOFF + 2)])
    return slices.select("part", F.struct("rank", added.alias("sums")).alias("slice")).groupBy("part").agg(F.collect_list("slice").alias("slices"))


def weigh_contexts(counted: DataFrame, d: np.ndarray) -> DataFrame:
    """Per part and block: counts of the n-grams it sent; total and scale of their contexts, and back-off weights of those with an unseen word."""
    def answers(row) -> pd.DataFrame:
        totals, mass, *counts_of = unpack_many(row.sums)
        n, mass, counts_of = totals.astype(float), mass.view("<f8").copy(), [c.astype(float) for c in counts_of]
        if row.slices is not None:
            ranks = np.array([x["rank"] for x in row.slices])
            for column, sums in zip([n, mass, *counts_of], np.array([x["sums"] for x in row.slices]).T, strict=True):
                column[ranks] = sums
        used = n - sum(c * r * (1 - d[r]) for r, c in enumerate(counts_of, 1))
        alpha, scale = context_weights(n, used, mass)
        n, out = n.astype(np.int64), []
        for sent in row.blocks:
            counts, ranks, open_ = unpack_many(sent["data"])
            out.append((sent["block"], row.part, pack_many([counts, n[ranks], scale[ranks], open_, alpha[ranks[open_ > 0]]])))
        return pd.DataFrame(out, columns=["block", "part", "data"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield answers(row)

    rows = counted.select("part", "sums", "blocks").join(F.broadcast(add_slices(counted)), "part", "left")
    return rows.mapInPandas(each, "block long, part int, data binary")


def _answered(row, grams: _Grams, number: np.ndarray, order: int, buckets: int, hot: int, below: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """The level of ``order`` of a block from what the parts sent back and what it knows by itself."""
    times, totals = np.zeros(grams.many[order - 1], np.int64), np.zeros(grams.many[order - 2], np.int64)
    scale, alpha, single = np.ones(len(totals)), np.ones(len(totals)), np.ones(len(times), np.int64)
    if len(times):
        own, alone, slices, suffixes = _own(row, grams, order, hot)
        every = grams.levels[order - 2][2]
        times[alone] = own[alone]
        seen = np.flatnonzero(alone & (own > 0))
        summed = lambda weights: np.bincount(every[seen], weights=weights, minlength=len(totals))
        totals[:] = summed(own[seen])
        alpha, scale = context_weights(totals, summed(d[np.minimum(own[seen], CUTOFF + 1)] * own[seen]), summed(_lower(*(x[seen] for x in suffixes), below)))
        sent, part, *_ = _messages(grams, number, order, buckets, alone, slices)
        got = [unpack_many(a["data"]) for a in sorted(row.answers, key=lambda a: a["part"])]
        told = np.concatenate([g[0] for g in got])
        times[sent], single[sent] = told >> 1, told & 1
        context = every[sent]
        fresh = _runs(part, context)
        context, open_ = context[fresh], np.concatenate([g[3] for g in got]) > 0
        totals[context] = np.concatenate([g[1] for g in got])
        scale[context] = np.concatenate([g[2] for g in got]).view("<f8")
        alpha[context[open_]] = np.concatenate([g[4] for g in got]).view("<f8")
    return times, totals, scale, alpha, single


def next_level(joined: DataFrame, order: int, buckets: int, hot: int, below: np.ndarray, d: np.ndarray) -> DataFrame:
    """Blocks with the level of ``order`` added."""
    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                grams, number, _ = _grams(row, order)
                yield pd.DataFrame({
                    "block": [row.block], "ids": [row.ids], "known": [row.known], "train": [row.train], "sizes": [row.sizes], "tokens": [row.tokens], "start": [row.start],
                    "words": [row.words], "levels": [[*row.levels, pack_many(list(_answered(row, grams, number, order, buckets, hot, below, d)))]],
                })

    return joined.mapInPandas(added, STATE)


def _probability(grams: _Grams, levels: list, counts: np.ndarray, stats: list[int], ds: list[np.ndarray]) -> np.ndarray:
    """The probability of every token: that of the longest n-gram seen, else the shorter one's times the context's back-off weight."""
    p = words_probability(counts[grams.text], stats)
    for (at, _, context, _, longer), (times, totals, scale, alpha, _), d in zip(grams.levels, levels, ds, strict=True):
        g = longer[at]
        c, t = context[g], times[g]
        p[at] = np.where(t > 0, scale[c] * d[np.minimum(t, CUTOFF + 1)] * t / np.maximum(totals[c], 1), alpha[c] * p[at])
    return p


def scores(state: DataFrame, order: int, buckets: int, hot: int, stats: list[int], ds: list[np.ndarray]) -> DataFrame:
    """Scores of every text from blocks that know all levels, or all but the last, whose ``answers`` they carry."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                grams, number, counts = _grams(row, order)
                levels = [_level(row, k) for k in range(2, len(row.levels) + 2)]
                if len(levels) < order - 1:
                    levels.append(_answered(row, grams, number, order, buckets, hot, *ds[-2:]))
                logs = np.log10(_probability(grams, levels, counts, stats, ds))[grams.plain]
                tok, sizes = grams.text[grams.plain], unpack(row.sizes, "u4").astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                base = np.log10((counts[tok] + 1) / (stats[0] + stats[1] + 1))
                known = unpack(row.known, "u1").astype(bool)
                yield pd.DataFrame({
                    "doc_id": pd.Series(unpack(row.ids, "i8"), dtype="Int64").where(known),
                    "n_tokens": sizes, "n_known": np.add.reduceat((counts[tok] > 0).astype(np.int64), starts),
                    "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts),
                })

    return state.mapInPandas(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def katz_scores(docs: DataFrame, *, modulus: int = 7, remainder: int = 2, block: int = BLOCK, order: int = ORDER) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row of ``docs``.

    The model has n-grams of up to ``order`` words (2 at least). It learns from the rows that are not held out (crc32 of the id as
    text, mod ``modulus``, is not ``remainder``) and scores all. A null text is
    empty and has one token, the end. Rows that repeat an id are each counted
    and scored; a null id is never held out. If nothing is left to learn from,
    all probability is with the unknown class and scores are 0. Texts may be
    of any length; one that is longer than a block is a block of its own.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out(F.col("doc_id"), modulus, remainder)).alias("train"))
    spark = docs.sparkSession
    cut = table(blocks(plain, block), "katz-blocks")
    state = cut.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("held"), F.lit(0)).alias("tokens")).first()
    buckets, spread = max(8, int(-(-(state["bytes"] / 8) // SLICE))), max(SPREAD, -(-state["blocks"] // SHARED))
    words = table(count_words(word_requests(cut, buckets), buckets), "katz-words")
    stats = _sums(words.where("block IS NULL"), CUTOFF + 3)
    mine = words.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "ranks", "counts")).alias("words"))
    known = table(numbered(cut.drop("hashes", "held").join(mine, "block"), buckets), "katz-numbered")
    drop(cut)
    release(spark)
    bigrams = table(count_bigrams(bigram_requests(known, buckets, spread)), "katz-bigrams")
    d = discounts(_sums(bigrams.where("block IS NULL"), CUTOFF + 1))
    release(spark)
    contexts = table(backoff_weights(context_sums(bigrams, words, buckets, stats, d, spread), words), "katz-contexts")
    drop(words)
    release(spark)
    weights = contexts.groupBy("block").agg(F.collect_list(F.struct("bucket", "alpha", "scale")).alias("weights"))
    counts = bigrams.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "times")).alias("bigrams"))
    tokens, ds = state["tokens"], [d]
    state = table(_first_levels(known.join(weights, "block").join(counts, "block"), buckets, spread), "katz-state")
    for done in (known, bigrams, contexts):
        drop(done)  # the state holds all that is still asked of them
    buckets, hot = max(8, -(-tokens // PART)), max(HOT, -(-tokens // SLICED))
    for k in range(3, order + 1):
        release(spark)
        counted = table(count_grams(gram_requests(state, k, buckets, hot), k, ds[-1]), f"katz-{k}-grams")
        ds.append(discounts(_sums(counted, CUTOFF + 1)))
        release(spark)
        told = table(weigh_contexts(counted, ds[-1]), "katz-answers")
        drop(counted)
        release(spark)
        joined = state.join(told.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("answers")), "block", "left")
        if k < order:
            asked, state = state, table(next_level(joined, k, buckets, hot, *ds[-2:]), "katz-state")
            drop(asked)
            drop(told)
        else:
            state = joined
    found = scores(state, order, buckets, hot, stats, ds)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "n_tokens", "n_known",
        F.lit(stats[0]).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Element-wise sums of ``stats``."""
    got = rows.select(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]).first()
    return [int(v or 0) for v in got]
