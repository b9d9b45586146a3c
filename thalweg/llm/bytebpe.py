"""Byte-level BPE: texts to token ids with byte offsets, and back.

Texts are cut into slices as the pattern of the vocabulary's public tokenizer
has it (contractions, words, numbers and other runs with the space before them,
white space), but no regular expression runs. Every code point becomes one of
a few symbols: its class, the class of what follows white space, and whether an
apostrophe begins a contraction, which only needs its two neighbours. A machine
of eight states reads the symbols and says where slices begin. Its steps are
functions from state to state, and such functions compose associatively, so all
rows of a matrix of symbols are composed side by side, rows are joined by
doubling, and a second pass reads the boundaries off. A long text is scanned
window by window with the state carried over.

Slices are then merged pair by pair, lowest rank first, leftmost among equals:
each distinct slice once, many side by side, and those merged lately are looked
up. The ids keep the byte at which each token
ends, and decoding puts every token's bytes back there.

All is one pass over rows without a shuffle; a task holds one Arrow batch and
the arrays of one window.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Code points scanned at once, bytes of texts encoded at once, slices looked up at once, remembered slices, bytes of a slice that is remembered, bytes from which a heap finds the next pair.
WINDOW, CHUNK, RUN, KNOWN, SHORT, LONG = 1 << 19, 1 << 21, 1 << 20, 1 << 17, 64, 96
NONE = 1 << 60

LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, WHITE, SPACE, BREAK = range(8)  # symbols; 8 more for the first code point of a text
FIRST, NOTHING = 8, 16
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)  # states


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """``(step, cut)``: the next state, and whether a slice begins here, by symbol and state."""
    step, cut = np.zeros((NOTHING + 1, 8), np.uint8), np.zeros((NOTHING + 1, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE_1: IN_OTHERS, QUOTE_2: IN_OTHERS, WHITE: IN_WHITE}
    for symbol in range(8):
        for state in range(8):
            run = runs.get(symbol)
            if state in (ONE_MORE, TWO_MORE):  # inside a contraction
                step[symbol, state] = FRESH if state == ONE_MORE else ONE_MORE
            elif state == AFTER_SPACE and run is not None:  # the space takes what follows along
                step[symbol, state] = run
            elif run is not None and state == run:
                step[symbol, state] = run
            else:
                cut[symbol, state] = True
                step[symbol, state] = {QUOTE_1: ONE_MORE, QUOTE_2: TWO_MORE, SPACE: AFTER_SPACE, BREAK: FRESH}.get(symbol, run)
        step[FIRST + symbol], cut[FIRST + symbol] = step[symbol, FRESH], True
    step[NOTHING] = np.arange(8)
    return step, cut


#: Both tables by ``8 * symbol + state``, as bytes that translate bytes.
STEP, CUT = (m.astype(np.uint8).tobytes().ljust(256, b"\0") for m in _machine())


def scan(symbols: np.ndarray, state: int = FRESH) -> tuple[np.ndarray, int]:
    """Where slices begin, and the state after the last symbol.

    The symbols lie in rows of a matrix. Pass one composes the functions of
    each row, all rows at once; the rows' functions are composed by doubling,
    which gives each row the state it starts in; pass two reads the cuts.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, bool), state
    width = min(n, 512)
    rows = -(-n // width)
    grid = np.full(rows * width, NOTHING, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T) << 3  # a column of the matrix at a time
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = _looked_up(column[:, None] + whole, STEP)
    reach = 1
    while reach < rows:  # whole[r] becomes the function of rows 0 to r
        whole = np.concatenate([whole[:reach], np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), axis=1)])
        reach *= 2
    at = np.concatenate([np.array([state], np.uint8), whole[:-1, state]])
    cuts = np.empty((width, rows), np.uint8)
    for k, column in enumerate(grid):
        place = column + at
        cuts[k] = _looked_up(place, CUT)
        at = _looked_up(place, STEP)
    return cuts.T.ravel()[:n].view(bool), int(whole[-1, state])


def _looked_up(places: np.ndarray, entries: bytes) -> np.ndarray:
    return np.frombuffer(places.tobytes().translate(entries), np.uint8).reshape(places.shape)


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER of every code point, as the tokenizer library's own Unicode tables have them (Python's may be older)."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    points = np.setdiff1d(np.arange(0x110000, dtype="<u4"), np.arange(0xD800, 0xE000, dtype="<u4"))
    text, single = points.tobytes().decode("utf-32-le"), {bytes([b]): b for b in range(256)}
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        probe = tiktoken.Encoding(f"class-{kind}", pat_str=name, mergeable_ranks=single, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4")] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and where each begins."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.uint32)
    size = 1 + (lead >= 0xC0).astype(np.intp) + (lead >= 0xE0) + (lead >= 0xF0)
    points = np.where(size == 1, lead, lead & (0xFF >> (size + 1)).astype(np.uint32))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        points[more] = (points[more] << 6) | (data[np.minimum(starts[more] + k, len(data) - 1)] & 0x3F)
    return points, starts


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks those that begin a text."""
    kind = classes()[np.minimum(points, 0x10FFFF)]
    after = lambda x, k, fill: np.concatenate([x[k:], np.full(min(k, len(x)), fill, x.dtype)])
    ends_1, ends_2 = after(first, 1, True), after(first, 1, True) | after(first, 2, True)
    white = kind == WHITE
    last = white & ~ends_1 & ~after(white, 1, True)
    out = kind.copy()
    out[last] = BREAK
    out[last & (points == 0x20)] = SPACE
    quote = np.flatnonzero((points == 0x27) & ~ends_1)
    if len(quote):
        b = after(points, 1, 0)[quote]
        c = after(points, 2, 0)[quote]
        out[quote[np.isin(b, [ord(x) for x in "stmd"])]] = QUOTE_1
        pair = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (b == ord(x)) & (c == ord(y))
        out[quote[pair & ~ends_2[quote]]] = QUOTE_2
    return out + FIRST * first.astype(np.uint8)


def slice_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where slices of UTF-8 ``data`` begin; texts begin at ``begins`` (those of empty texts may repeat or be past the end)."""
    points, starts = code_points(data)
    first = np.zeros(len(points), bool)
    first[np.searchsorted(starts, np.unique(begins[begins < len(data)]))] = True
    found, state = [], FRESH
    for a in range(0, len(points), WINDOW):
        b = min(a + WINDOW, len(points))
        cuts, state = scan(_symbols(points[a : b + 2], first[a : b + 2])[: b - a], state)  # two more to look ahead
        found.append(starts[a:b][cuts])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Vocabulary:
    """Ranks of a byte-level vocabulary, the slices merged lately, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values(), default=-1) + 1
        names = [b""] * size
        for name, rank in self.ranks.items():
            names[rank] = name
        self.sizes = np.array([len(n) for n in names], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.known: dict[bytes, bytes] = {}
        # Any two ids whose bytes make up a third merge to it: its rank, by the pair.
        get, pairs = self.ranks.get, {}
        for name, rank in self.ranks.items():
            for k in range(1, len(name)):
                if (a := get(name[:k])) is not None and (b := get(name[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merges = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.single = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two ids merge to, NONE where they don't."""
        if not len(self.pairs):
            return np.full(len(left), NONE)
        wanted = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[place] == wanted, self.merges[place], NONE)

    def ids(self, slices: list[bytes]) -> list[bytes]:
        """The ids of each slice, as bytes of four-byte numbers. Slices not merged lately are merged, the short ones all at once."""
        found = list(map(self.known.get, slices))
        new = list(dict.fromkeys([s for s, f in zip(slices, found, strict=True) if f is None]))
        if not new:
            return found
        made: dict[bytes, bytes] = {}
        for piece in new:
            if piece in self.ranks:
                made[piece] = np.int32(self.ranks[piece]).tobytes()
            elif len(piece) >= LONG:
                made[piece] = np.array(self._by_heap(piece), np.int32).tobytes()
        made |= self._together([p for p in new if p not in made])
        out = [f if f is not None else made[s] for s, f in zip(slices, found, strict=True)]
        if len(self.known) + len(made) > KNOWN:
            self.known.clear()
        self.known |= {p: i for p, i in made.items() if len(p) <= SHORT}
        return out

    def _together(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Many slices merged side by side: in each round every slice merges its first pair of the lowest rank, and those without a pair are done."""
        out: dict[bytes, bytes] = {}
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts, own = self.single[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(parts), NONE)  # of a part and the one after it
        same = np.flatnonzero(own[:-1] == own[1:])
        rank[same] = self.ranked(parts[same], parts[same + 1])
        while len(parts):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lengths = np.diff(np.append(starts, len(parts)))
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                blob, at = parts[gone].astype(np.int32).tobytes(), 0
                for k, n in zip(own[starts[done]].tolist(), (4 * lengths[done]).tolist(), strict=True):
                    out[pieces[k]] = blob[at : at + n]
                    at += n
                parts, own, rank, low, lengths = parts[~gone], own[~gone], rank[~gone], low[~done], lengths[~done]
                if not len(parts):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, lengths))
            hits = hits[np.concatenate([[True], own[hits[1:]] != own[hits[:-1]]])]
            parts[hits] = rank[hits]
            stay = np.ones(len(parts), bool)
            stay[hits + 1] = False
            parts, own, rank = parts[stay], own[stay], rank[stay]
            hits -= np.arange(len(hits))  # one part less before each
            before = hits[hits > 0] - 1
            changed = np.concatenate([hits, before])
            rank[changed] = NONE
            changed = changed[changed + 1 < len(parts)]
            changed = changed[own[changed] == own[changed + 1]]
            rank[changed] = self.ranked(parts[changed], parts[changed + 1])
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        """One long slice in n log n steps: parts are linked, and a pair in the heap counts if both still end where they did."""
        ranks, n = self.ranks, len(piece)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at k
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, end = heapq.heappop(heap)
            middle = stop[k]
            if middle < 0 or middle >= n or stop[middle] != end:
                continue
            stop[k], stop[middle] = end, -1
            if end < n:
                before[end] = k
                if (r := ranks.get(piece[k : stop[end]])) is not None:
                    heapq.heappush(heap, (r, k, stop[end]))
            if k and (r := ranks.get(piece[before[k] : end])) is not None:
                heapq.heappush(heap, (r, before[k], end))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : stop[k]]])
            k = stop[k]
        return out

    def encoded(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` that ``bounds`` parts, the byte of its text at which each token ends, and where each text's tokens begin (and end)."""
        starts = slice_starts(data, bounds[:-1])
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        flat, counts = [], []
        for a in range(0, len(starts), RUN):
            # Slices that are alike are merged once, and their ids copied to all places.
            cut = np.append(starts[a : a + RUN], starts[a + RUN] if a + RUN < len(starts) else len(data)).astype(np.int64)
            slices = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)]).dictionary_encode()
            ids = self.ids(slices.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            which = slices.indices.to_numpy()
            counts.append(sizes[which])
            place = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(counts[-1]) - counts[-1]), counts[-1])
            flat.append(np.frombuffer(b"".join(ids), np.int32)[place + np.arange(len(place))])
        ids, tokens = np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        cuts = tokens[np.searchsorted(starts, bounds)]  # slices never reach over texts
        return ids, (np.cumsum(self.sizes[ids]) - np.repeat(bounds[:-1], np.diff(cuts))).astype(np.int32), cuts

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of one text's tokens, each put where it ends."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        if not np.array_equal(np.cumsum(sizes), ends):
            raise ValueError("token offsets don't fit the vocabulary")
        out = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(ids), RUN):
            size, begin = sizes[a : a + RUN], int(ends[a - 1]) if a else 0
            place = np.repeat(self.places[ids[a : a + RUN]] - (np.cumsum(size) - size), size)
            out[begin : begin + len(place)] = self.bytes[place + np.arange(len(place))]
        return out.tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its texts; null is empty."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            a = 0
            while a < batch.num_rows:  # texts of CHUNK bytes together, or one longer text
                b = min(max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1), batch.num_rows)
                ids, ends, cuts = words.encoded(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *lists], ["doc_id", "ids", "ends"])
                a = b

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            rows = zip(*[_parts(batch.column(c)) for c in ("ids", "ends")], strict=True)
            decoded = pa.array([words.decoded(i, e) for i, e in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    return run


def _encoded_schema(docs: DataFrame) -> StructType:
    ints = ArrayType(IntegerType(), False)
    return StructType([docs.schema["doc_id"], StructField("ids", ints), StructField("ends", ints)])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, ends)`` of ``docs(doc_id, text)``: token ids of each whole text and the byte at which each token ends.

    ``path`` names a file of ranks that every executor can read. Null and empty
    texts have no tokens; rows that repeat are encoded each and null ids are
    kept; a very long text is scanned in windows; strings of special tokens are
    plain text; other columns are left out, whatever their names; an empty
    table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder(path), _encoded_schema(docs))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens(ids, ends, ...)`` with ``decoded``: the bytes of the tokens, each put where its offset says.

    Bytes of a text cut inside a character need not be UTF-8, so the result is
    binary. Null or empty lists give no bytes; offsets that don't fit the ids
    are an error. Other columns travel along; one named ``decoded`` is replaced.
    """
    given = tokens.drop("decoded")
    return given.mapInArrow(_decoder(path), StructType([*given.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``(doc_id, ids, ends, decoded)``."""
    encoded, decoded = _encoder(path), _decoder(path)
    schema = StructType([*_encoded_schema(docs).fields, StructField("decoded", BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decoded(encoded(batches)), schema)


def _parts(lists: pa.Array) -> Iterator[np.ndarray]:
    flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return (flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: texts encoded and decoded again."""
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
