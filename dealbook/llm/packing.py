"""Best-fit packing of documents into token sequences by a tree of residual rounds.

Every partition packs its own documents by best fit, emits the sequences that
are nearly full and hands the underfull ones up. Above it, groups of partitions
merge: an underfull sequence is an item of its filled length, items are packed
by best fit again, and so on until one group is left or a round merges nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches, written
from dealbook.llm.tokens import END, VOCABULARY, encoder

LENGTH = 2048
#: Items that one task packs at a time.
GROUP_ITEMS = 60_000
#: A piece in a bin's member bytes: doc_id, known, piece, start, length, ids_crc32.
FIELDS = 6

BIN = "filled int, members binary, done boolean, lead long"


def pieces(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces: a document over ``limit`` is cut from its end, the first piece takes the rest."""
    n = np.maximum(1, -(-lengths // limit))
    doc = np.repeat(np.arange(lengths.size), n)
    at = np.arange(doc.size) - np.repeat(np.cumsum(n) - n, n)
    head = lengths - (n - 1) * limit
    start = np.where(at == 0, 0, head[doc] + (at - 1) * limit)
    return doc, start, np.where(at == 0, head[doc], limit)


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Best fit, largest first: each item goes to the fullest sequence that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), limit
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def packed(sizes: np.ndarray, members: list[bytes], limit: int) -> pd.DataFrame:
    """Bins of the given items; a bin's member bytes are its items' in order."""
    rows = []
    for bin_ in best_fit(sizes, limit):
        filled = int(sizes[bin_].sum())
        held = b"".join([members[i] for i in bin_])
        rows.append((filled, held, limit == filled, zlib.crc32(held)))
    return pd.DataFrame(rows, columns=["filled", "members", "done", "lead"]).astype(
        {"filled": "int32", "lead": "int64", "done": "bool"})


def local_round(batches: Iterator[pd.DataFrame], name: str, limit: int, group_items: int) -> Iterator[pd.DataFrame]:
    """Tokenises a partition's documents and packs their pieces, ``group_items`` at a time."""
    enc = encoder(name)
    sizes: list[np.ndarray] = []
    members: list[bytes] = []

    def flush():
        out = packed(np.concatenate(sizes), members, limit)
        sizes.clear()
        members.clear()
        return out

    for pdf in batches:
        texts, docs = pdf["text"].tolist(), pdf["doc_id"]
        known = docs.notna().to_numpy().astype(np.int64)
        docs = docs.fillna(0).to_numpy().astype(np.int64)
        for first in range(0, len(texts), 512):
            some = [None if isinstance(t, float) else t for t in texts[first: first + 512]]
            ids = [np.append(x, np.uint32(END)) for x in enc.encode(some)]
            doc, start, length = pieces(np.array([x.size for x in ids]), limit)
            crc = [zlib.crc32(ids[d][s: s + n].astype("<u4").tobytes())
                   for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            piece = np.arange(doc.size) - np.searchsorted(doc, doc)
            table = np.column_stack((docs[first + doc], known[first + doc], piece, start, length, crc)).astype(np.int64)
            full = length == limit
            if full.any():
                held = [row.tobytes() for row in table[full]]
                yield pd.DataFrame({"filled": np.int32(limit), "members": held, "done": True,
                                    "lead": [zlib.crc32(x) for x in held]})
            sizes.append(length[~full])
            members += [row.tobytes() for row in table[~full]]
        if len(members) >= group_items:
            yield flush()
    if members:
        yield flush()


def merge_round(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Packs underfull sequences as items; their order does not depend on how rows arrive."""
    rows = rows.sort_values(["filled", "lead", "members"], ascending=[False, True, True])
    return packed(rows["filled"].to_numpy().astype(np.int64), rows["members"].tolist(), limit)


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per piece of each sequence, with its place there."""
    for pdf in batches:
        counts = (pdf["members"].str.len() // (8 * FIELDS)).to_numpy()
        t = np.frombuffer(b"".join(pdf["members"]), np.int64).reshape(-1, FIELDS)
        ends = np.cumsum(t[:, 4])
        first = np.cumsum(counts) - counts
        base = (ends - t[:, 4])[first]
        yield pd.DataFrame({
            "doc_id": pd.Series(t[:, 0], dtype="Int64").where(t[:, 1] == 1), "piece": t[:, 2].astype(np.int32),
            "start": t[:, 3], "length": t[:, 4], "ids_crc32": t[:, 5],
            "sequence_id": np.repeat(pdf["sequence_id"].to_numpy(), counts),
            "offset": ends - t[:, 4] - np.repeat(base, counts)})


def pack(docs: DataFrame, limit: int = LENGTH, vocabulary: str = VOCABULARY,
         group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every document's tokens in sequences of at most ``limit`` places, one row per piece.

    A document is its token ids and an end id, so an empty or null text is one
    token. Only documents over ``limit`` tokens are cut. Each row tells where a piece
    starts in its document (``start``), its ``length``, the CRC of its ids, and
    where it lies (``sequence_id``, ``offset``). Rows that repeat or have a
    null doc_id are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    bins = written(docs.mapInPandas(lambda it: local_round(it, vocabulary, limit, group_items), BIN), "bins")
    finished = [bins.where("done")]

    def open_bins(df: DataFrame) -> tuple[DataFrame, int]:
        """Underfull bins that the smallest of them still fits, and their number; the others are finished."""
        under = df.where("not done")
        least = under.agg(F.min("filled")).first()[0] or 0
        finished.append(under.where(F.lit(limit) - F.col("filled") < least))
        rest = under.where(F.lit(limit) - F.col("filled") >= least)
        return rest, rest.count()

    rest, n = open_bins(bins)
    while n > 1:
        # Each group mixes all lengths: it is dealt by a hash of its members.
        groups = max(1, -(-n // group_items))
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("members"), F.lit(groups)))
        merged = written(dealt.groupBy("g").applyInPandas(
            lambda rows: merge_round(rows.drop(columns=["g", "done"]), limit), BIN), "bins")
        finished.append(merged.where("done"))
        rest, left = open_bins(merged)
        if groups == 1 or left > 0.98 * n:
            break
        n = left
    out = rest
    for df in finished:
        out = out.unionByName(df)
    numbered = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInPandas(unpacked, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                          "sequence_id long, offset long")
