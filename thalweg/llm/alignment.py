"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other.

A text's bytes carry one label each: none, a token of A ends here, one of B, or
both. A regular expression scans the labels and takes spans up to each label
*both*; how often A and B end inside a span says how many tokens its group has.

Both vocabularies cut where a space follows a character that is no white space:
B has no piece in which a space comes after anything else, and A's pattern
begins a slice there. So a text is a row of words whose groups don't depend on
each other; distinct words are encoded and aligned once a chunk and their ids
copied to all places. Where a vocabulary doesn't cut like that (looked up when
it is read), whole texts take the place of words.

How often two ids are linked in all texts is one combinable sum. The few pairs
that hold a fixed share of all links each can't be more than its inverse, and
are broadcast; rows of the other pairs, none of which is common, meet their
counts by a join. A text's links travel as distinct pairs with their number.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from thalweg.llm.bytebpe import WHITE, classes, code_points, text_buffers
from thalweg.llm.common import table

#: Bytes of texts aligned at once, the share of all links from which a pair is common (one in so many).
CHUNK, COMMON = 1 << 21, 10_000
NONE, A_ENDS, B_ENDS, BOTH = b".ABX"
SPAN = re.compile(rb"[.AB]*X")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others counted up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in [*zip(plain, plain, strict=True), *((256 + k, b) for k, b in enumerate(rest))]}


class Side:
    """The bytes of a tokenizer's ids, one after the other, and its ids as text with what follows them in a group."""

    def __init__(self, names: list[bytes], between: str, after: str):
        self.sizes = np.array([len(n) for n in names], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.said = [f"{i}{mark}" for mark in (between, after) for i in range(len(names))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return self.bytes[np.repeat(self.places[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


@dataclass
class Words:
    """Words aligned, all columns one after the other: how many entries each word has, and the entries."""

    fits: np.ndarray
    counts: dict[str, np.ndarray]
    values: dict[str, np.ndarray]
    text: list[str]


class Pair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        back, special = byte_characters(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        names = {i: t.encode() if t in special else bytes(back[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.a_bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.sides = Side(self.a_bytes, ",", "|"), Side(self.b_bytes, ",", ";")
        rules = json.loads(self.a.to_str())
        cut = rules["pre_tokenizer"] or {}
        plain = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.words = plain and not any("▁" in piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))

    def starts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words begin: with every text, and at spaces after a character that is no white space."""
        begins = begins[begins < len(data)]
        if not self.words:
            return np.unique(begins)
        points, at = code_points(data)
        white = classes()[points] == WHITE
        first = np.zeros(len(data), bool)
        first[at[1:][(points[1:] == 0x20) & ~white[:-1]]] = True
        first[begins] = True
        return np.flatnonzero(first)

    def aligned(self, words: list[bytes]) -> Words:
        """Groups and links of words, the first byte of each a space. Words that a tokenizer doesn't give back byte by byte have none."""
        texts = [w.decode() for w in words]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)  # B adds the space, but not to nothing
        b = [ids if t != " " else [self.b.piece_to_id("▁")] for ids, t in zip(b, texts, strict=True)]
        sizes, flat, fits = np.array(list(map(len, words)), np.int64), [], np.ones(len(words), bool)
        blob, own = np.frombuffer(b"".join(words), np.uint8), np.arange(len(words))
        for side, ids in zip(self.sides, (a, b), strict=True):
            each, count = np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append([each, np.repeat(own, count)])
            fits &= np.bincount(flat[-1][1], side.sizes[each], len(words)).astype(np.int64) == sizes
        for (each, word), side in zip(flat, self.sides, strict=True):
            same = fits[word]
            where = np.repeat(own, np.where(fits, sizes, 0))
            odd = side.joined(each[same]) != blob[np.repeat(fits, sizes)]
            fits[where[odd]] = False
        for column in flat:
            stay = fits[column[1]]
            column[:] = [column[0][stay], column[1][stay]]
        total = int(sizes[fits].sum())
        ends = [np.cumsum(side.sizes[each]) for side, (each, _) in zip(self.sides, flat, strict=True)]
        labels = np.full(total, NONE, np.uint8)
        labels[ends[0] - 1] = A_ENDS
        labels[ends[1] - 1] = np.where(labels[ends[1] - 1] == A_ENDS, BOTH, B_ENDS)
        spans = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64))  # where they end; a word always ends with one
        upto = [np.searchsorted(e, spans, "right") for e in ends]  # tokens up to there: as many labels
        group_of = np.searchsorted(np.cumsum(np.where(fits, sizes, 0)), spans, "left")
        values = {"a_ids": flat[0][0], "b_ids": flat[1][0], "a_sizes": np.diff(upto[0], prepend=0).astype(np.int32), "b_sizes": np.diff(upto[1], prepend=0).astype(np.int32)}
        values["links"] = values["a_ids"][upto[0] - 1].astype(np.int64) << 32 | values["b_ids"][upto[1] - 1]
        each_word = lambda w: np.bincount(w, minlength=len(words))
        counts = {"a_ids": each_word(flat[0][1]), "b_ids": each_word(flat[1][1])} | dict.fromkeys(("a_sizes", "b_sizes", "links"), each_word(group_of))
        return Words(fits, counts, values, self._said(values, upto, [f[1] for f in flat], len(words)))

    def _said(self, values: dict[str, np.ndarray], upto: list[np.ndarray], owners: list[np.ndarray], n: int) -> list[str]:
        """The groups of each word as text: each id with the mark that follows it, in the order of the text."""
        n_a, n_b = len(values["a_ids"]), len(values["b_ids"])
        kind, word = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.int64)
        group_a, group_b = np.repeat(np.arange(len(upto[0])), values["a_sizes"]), np.repeat(np.arange(len(upto[1])), values["b_sizes"])
        before = np.concatenate([[0], upto[1]])[group_a]
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[upto[0] - 1] = 1
        last_b[upto[1] - 1] = 1
        width_a, width_b = len(self.a_bytes), len(self.b_bytes)
        at_a, at_b = np.arange(n_a) + before, np.arange(n_b) + upto[0][group_b]
        kind[at_a], word[at_a] = values["a_ids"] + width_a * last_a, owners[0]
        kind[at_b], word[at_b] = 2 * width_a + values["b_ids"] + width_b * last_b, owners[1]
        parts = list(map(self._marks.__getitem__, kind.tolist()))
        ends = np.cumsum(np.bincount(word, np.fromiter(map(len, parts), np.int64, len(parts)), n)).astype(np.int64).tolist()
        whole = "".join(parts)
        return [whole[x : max(x, y - 1)] for x, y in zip([0, *ends], ends, strict=False)]

    @cached_property
    def _marks(self) -> list[str]:
        return self.sides[0].said + self.sides[1].said


@lru_cache(2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_sizes, b_sizes, links, times, groups)`` of ``docs(doc_id, text)``.

    A encodes a space and the text, B the text, to which it adds the space
    itself. ``a_sizes`` and ``b_sizes`` are the groups' numbers of tokens,
    ``links`` the distinct pairs of ids that end together (``a << 32 | b``),
    ``times`` how often, ``groups`` all groups as text (``a1,a2|b1;a3|b2``).
    Texts that are null, empty, or that one of the tokenizers doesn't give back
    byte by byte have empty lists. Rows that repeat are aligned each, null ids
    are kept, a very long text is a chunk by itself, strings of special tokens
    are plain text, other columns are left out whatever their names, and an
    empty table gives no rows.
    """
    ints = ArrayType(IntegerType(), False)
    schema = StructType([
        docs.schema["doc_id"], StructField("a_ids", ints), StructField("b_ids", ints), StructField("a_sizes", ints), StructField("b_sizes", ints),
        StructField("links", ArrayType(LongType(), False)), StructField("times", ints), StructField("groups", StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            data, bounds = text_buffers(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
            a = 0
            while a < batch.num_rows:
                b = min(max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1), batch.num_rows)
                columns = _chunk(both, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], empty[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], schema.names)
                a = b

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _chunk(both: Pair, data: np.ndarray, bounds: np.ndarray, empty: np.ndarray) -> list[pa.Array]:
    """The columns of the texts in ``data`` that ``bounds`` parts."""
    starts = both.starts(data, bounds[:-1])
    cut = np.append(starts, len(data)).astype(np.int64)
    slices = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    found, which = both.aligned(slices.dictionary.to_pylist()), slices.indices.to_numpy()
    words = np.searchsorted(starts, bounds)  # the words of each text
    text = np.repeat(np.arange(len(empty)), np.diff(words))
    out = empty.copy()
    out[text[~found.fits[which]]] = True
    stay = ~out[text]
    which, text = which[stay], text[stay]

    def gathered(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words in their places, and each text's bounds."""
        size = found.counts[name]
        many = size[which]
        place = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return found.values[name][place], np.concatenate([[0], np.cumsum(np.bincount(text, many, len(empty)).astype(np.int64))])

    lists = [pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(v, pa.int32())) for v, b in map(gathered, ("a_ids", "b_ids", "a_sizes", "b_sizes"))]
    links, ends = gathered("links")
    own = np.repeat(np.arange(len(empty)), np.diff(ends))
    order = np.lexsort((links, own))
    links, own = links[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (links[1:] != links[:-1]) | (own[1:] != own[:-1])])) if len(links) else np.zeros(0, np.int64)
    at = pa.array(np.searchsorted(own[first], np.arange(len(empty) + 1)), pa.int32())
    lists += [pa.ListArray.from_arrays(at, pa.array(links[first], pa.int64())), pa.ListArray.from_arrays(at, pa.array(np.diff(np.append(first, len(links))), pa.int32()))]
    said, places = found.text, np.searchsorted(text, np.arange(len(empty) + 1)).tolist()
    named = which.tolist()
    return [*lists, pa.array([";".join([said[w] for w in named[a:b]]) for a, b in zip(places[:-1], places[1:], strict=True)], pa.string())]


def linked(links: DataFrame) -> DataFrame:
    """``(row, n_best, count_sum)`` of ``links(row, links, times)``: a row's links whose pair is the commonest of its B id, and the corpus-wide counts summed over its links.

    A row without links doesn't appear.
    """
    each = links.select("row", F.explode(F.arrays_zip("links", "times")).alias("l")).select("row", F.col("l.links").alias("pair"), F.col("l.times").cast("long").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("times")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    best = counts.groupBy("b").agg(F.max("times").alias("most"))
    counts = table(counts.join(best, "b").select("pair", "times", (F.col("times") == F.col("most")).alias("best")), "pairs")
    total = counts.agg(F.sum("times")).first()[0] or 0
    common = counts.where(F.col("times") * COMMON > total)  # fewer than COMMON pairs, whatever the corpus
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    often = each.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    rare = each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(counts, "pair").groupBy("row").agg(*sums)
    return often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs(doc_id, text)``.

    Each group ends in one link, so there are as many of these. The digest of
    a text without tokens is ''.
    """
    long = lambda c, name: F.size(c).cast("long").alias(name)
    rows = table(align(docs, a_path, b_path).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", long("a_ids", "n_a"), long("b_ids", "n_b"), long("a_sizes", "n_groups"),
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"), "links", "times",
    ), "aligned")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("links", "times").join(linked(rows.select("row", "links", "times")), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )
