"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)


def token_count(text):
    """Words of white-space separated text, and one end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 16.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin size of each piece, by variable-capacity best fit.

    Pieces go longest first (ties in the given order) into the open bin that
    leaves least room. Where none fits, a bin is opened in the size of least
    cost: size plus ``overhead``, per token that the piece and the pieces
    still waiting can fill it with. At the end each bin shrinks to the
    smallest permitted size that holds its contents. Each length must be 1 to
    the largest capacity.
    """
    sizes = sorted(capacities)
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms that some open bin has
    # Tokens still waiting in pieces of at most each size's room decide what a new bin can be filled with.
    waiting = Counter(lengths.tolist())
    keys = sorted(waiting)
    tokens = np.array([k * waiting[k] for k in keys], dtype=float)
    for i in order.tolist():
        length = int(lengths[i])
        tokens[bisect_left(keys, length)] -= length
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[at]
        else:
            best = None
            for size in sizes[bisect_left(sizes, length):]:
                upto = bisect_left(keys, size - length + 1)
                fill = min(size, length + float(tokens[:upto].sum())) if upto else length
                cost = (size + overhead) / fill
                if best is None or cost < best[0]:
                    best = (cost, size)
            room, b = best[1], len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        room -= length
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_by_room[room].append(b)
    final = np.array([sizes[bisect_left(sizes, u)] for u in used], dtype=np.int64) if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if n else final


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = 20000) -> DataFrame:
    """Every document's tokens laid into bins; a row per piece.

    Returns ``doc_id, piece, start, n_tokens, bin_id, bin_size, bin_offset``:
    tokens ``start`` to ``start + n_tokens`` of the document lie at
    ``bin_offset`` of bin ``bin_id``, which is ``bin_size`` long. A document
    longer than the largest size is cut into pieces of that size and a rest,
    so every token is packed. Null and empty texts are one end mark. Rows that
    repeat an id are packed each; a null id is kept, an empty table gives no
    rows and other columns are ignored. Pieces are dealt by a hash into groups
    of at most about ``group_pieces``, as many groups as the texts' lengths
    call for, and each group is packed on its own; what grouping costs is a
    few half-filled bins per group.
    """
    top = max(capacities)
    pieces = (
        docs.select("doc_id", token_count(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("salt"))
        .select("doc_id", "n", "salt", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / top).cast("int"))).alias("piece"))
        .select("doc_id", "piece", "salt", (F.col("piece") * top).cast("long").alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("int").alias("n_tokens"))
    )
    # A token takes two characters at least but for the last, which bounds the pieces without splitting any text.
    state = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars")).first()
    groups = max(1, -(-(state["n"] + state["chars"] // (2 * top)) // group_pieces))
    # The text is part of the hash, so that rows without an id don't fall together.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("salt", "piece"), F.lit(groups)))

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "n_tokens"], ignore_index=True)
        bins, offsets, final = pack(part["n_tokens"].to_numpy(np.int64), capacities)
        return part.drop(columns=["pack_group", "salt"]).assign(bin_id=[f"{key[0]}-{b}" for b in bins], bin_size=final, bin_offset=offsets)

    # Ids go through pandas as two halves, so that a null among them turns none into a float.
    halves = dealt.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), *[c for c in dealt.columns if c != "doc_id"])
    laid = halves.groupBy("pack_group").applyInPandas(
        packed, "no_id boolean, doc_id long, piece int, start long, n_tokens int, bin_id string, bin_size int, bin_offset int"
    )
    return laid.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
