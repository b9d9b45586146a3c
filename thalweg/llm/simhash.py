"""Near-duplicate documents by SimHash, found with Golay-code keys.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of
the perfect binary Golay code. Every 23-bit word lies within three bits of
exactly one codeword, and two words at most two bits apart always have a word
within one bit of both; so the codewords that a segment and its 23 one-bit
neighbours decode to (one or six of them) share at least one index whenever
two segments differ in at most two bits. With two errors in all, one segment
is untouched whose following segment (around the circle of three) has at most
two: a key of an exact segment and a Golay index of the next one therefore
meets for every pair within two bits.
Pairs are looked for among distinct fingerprints only, so exact copies cost
nothing, and each key's members are verified by their true distance and linked
as a spanning forest, never as all pairs. A key that very many fingerprints
share is split by the indices of the third segment, which any pair within two
bits shares too; what then is still together differs in a few bits at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm import jaccard
from thalweg.llm.common import checkpointed, components, table

#: Generator polynomial of the binary Golay code of length 23, one of two mirror images.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
#: Keys with more fingerprints are split by the third segment, in which two fingerprints within two bits share an index as well.
HOT = 4096


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def _errors() -> np.ndarray:
    """The error of each remainder: the one pattern of at most three bits that leaves it."""
    patterns = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(23), k)], dtype=np.int64)
    out = np.zeros(2048, dtype=np.int64)
    out[syndrome(patterns)] = patterns
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word its codeword indices, as rows of 24 sorted numbers with repeats."""
    ball = words.astype(np.int64)[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
    return np.sort((ball ^ _ERRORS[syndrome(ball)]) >> 11, axis=1)


_ERRORS = _errors()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows ``(doc_id, fp)``, a row per row of ``docs``, of whole texts."""
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(computed, "doc_id long, fp long")


def keys(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the index of the fingerprint each belongs to; fingerprints at most ``bits`` apart share one.

    Beyond two bits there are so many segments that two of them have at most
    two errors each, whatever the errors are: a key is a Golay index of both.
    """
    if bits <= 2:
        cuts, dealt = SEGMENTS, [(s, (s + 1) % 3) for s in range(3)]
    else:
        ends = [64 * k // max(3, bits // 3 + 2) for k in range(max(3, bits // 3 + 2) + 1)]
        cuts = [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
        dealt = list(combinations(range(len(cuts)), 2))
    raw = fps.view(np.uint64)
    segments = [((raw >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in cuts]
    near = [golay_keys(s) for s in segments]
    fresh = [np.concatenate([np.ones((len(g), 1), bool), g[:, 1:] != g[:, :-1]], axis=1) for g in near]
    found, owners = [], []
    for turn, (s, t) in enumerate(dealt):
        if bits <= 2:
            row, col = np.nonzero(fresh[t])
            found.append(((s * 3 + t) << 34) | (segments[s][row] << 12) | near[t][row, col])
        else:
            row, one, two = np.nonzero(fresh[s][:, :, None] & fresh[t][:, None, :])
            found.append((turn << 24) | (near[s][row, one] << 12) | near[t][row, two])
        owners.append(row)
    return np.concatenate(found), np.concatenate(owners)


def third_keys(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrower keys for rows of keys for two bits: each with the Golay indices of the segment that the key leaves out."""
    third = (3 - (key >> 34) // 3 - (key >> 34) % 3).astype(np.int64)  # the key begins with the numbers of its two segments
    raw = fps.view(np.uint64)
    words = np.zeros(len(fps), np.int64)
    for s, (a, w) in enumerate(SEGMENTS):
        words = np.where(third == s, ((raw >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64), words)
    near = golay_keys(words)
    row, col = np.nonzero(np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1))
    return (1 << 62) | (key[row] << 12) | near[row, col], row


def linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints at most ``bits`` apart, as pairs (root, member).

    Breadth first: each reached fingerprint is held against those not yet
    reached, so a tight group of any size is gone through once.
    """
    rest = np.sort(fps)
    out = []
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ np.int64(queue.pop())) <= bits
            if near.any():
                got = rest[near].tolist()
                rest = rest[~near]
                queue += got
                out += [(root, g) for g in got]
    return out


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Edges ``(a, b)`` of fingerprints ``fp`` whose components are those of all links of at most ``bits``."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            fps = part.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 4096):
                k, owner = keys(fps[at : at + 4096], bits)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[at : at + 4096][owner])], ["key", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part in [*_whole(batches), None]:
            if part is None:
                k, f = held
                last = len(k)
            else:
                k = np.concatenate([held[0], part.column("key").to_numpy(zero_copy_only=False)])
                f = np.concatenate([held[1], part.column("fp").to_numpy(zero_copy_only=False)])
                last = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on
            cut = np.flatnonzero(np.diff(k[:last])) + 1
            bounds = np.concatenate([[0], cut, [last]]) if last else np.zeros(1, np.int64)
            pairs = []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                pairs += linked(f[bounds[i] : bounds[i + 1]], bits)
            held = (k[last:], f[last:])
            a, b = (np.array([p[j] for p in pairs], dtype=np.int64) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            k, fps = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp"))
            more, owner = third_keys(k, fps)
            yield pa.RecordBatch.from_arrays([pa.array(more), pa.array(fps[owner])], ["key", "fp"])

    found = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    if bits <= 2:
        hot = checkpointed(found.groupBy("key").count().where(F.col("count") > HOT).select("key"))
        if hot.limit(1).count():
            split = found.join(hot, "key", "left_semi").mapInArrow(narrowed, "key long, fp long")
            found = found.join(hot, "key", "left_anti").unionByName(split)
    dealt = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    return dealt.sortWithinPartitions("key").mapInArrow(verified, "a long, b long").distinct()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bits: int = 2) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``, a row per row of ``docs``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked;
    ``component_id`` is the smallest id that links reach, the row's own
    included. Letters A-Z are lower-cased, words split at ASCII white space;
    a text of fewer words than a shingle is one shingle, and null, empty and
    blank texts all have fingerprint zero. Ids may repeat; a null id never
    names a component (a component of null ids only has a null one).
    """
    docs_fp = table(fingerprints(docs, shingle), "fingerprints")
    distinct = checkpointed(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct, bits)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = checkpointed(distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(rooted.join(names, "root").select("fp", "component_id"))
    return docs_fp.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id, null ids after all others.

    Linked are all texts whose sets of shingles have a Jaccard similarity of
    0.8 or more, see ``jaccard``. Columns are kept as they are. The survivor
    is told by its id and a hash of its text, so ids may repeat or be null;
    of rows that repeat both, one is kept.
    """
    rows = jaccard.grouped(docs, shingle=shingle)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    kept = checkpointed(rows.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).select("first.doc_id", "first.mark", "size"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.mark"))
    alone = docs.alias("d").join(kept.where("size = 1").alias("k"), same, "left_semi")
    more = docs.alias("d").join(kept.where("size > 1").alias("k"), same, "left_semi")
    return alone.unionByName(more.withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"]).drop("_mark"))
