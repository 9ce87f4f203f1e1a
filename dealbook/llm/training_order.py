"""Training-order materialisation: token sequences written where a keyed permutation puts them.

Texts become fixed-length token sequences. Sequence i of N goes to global slot
p(i), where p is a Feistel network on the next power of four, walked along its
cycle until it lands below N: a keyed bijection that needs no table. Slots are
cut into ranges; each range is one shard, written in slot order with records of
one size, so a reader can start at any slot and read on sequentially.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches, written
from dealbook.llm.shingles import mix
from dealbook.llm.tokens import END, VOCABULARY, encoder
from dealbook.session import scratch_dir

LENGTH = 2048
KEY = 20_240_607
ROUNDS = 6
#: Sequences of one shard; with its 4,101-byte records a shard is about 34 MB.
SHARD_SEQUENCES = 8192
#: Tasks that write the shards at most; each writes whole shards one after the other.
SHARD_TASKS = 100_000
#: Sequences that a task stores as one row: bounds its memory.
ROW_SEQUENCES = 2048
HEADER = 4
#: Compression of sequences on their way to the shards.
LEVEL = 6


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index: a keyed permutation of 0 .. n - 1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(index, dtype=np.uint64).copy()
    walking = np.arange(out.size)
    while walking.size:
        x = out[walking]
        left, right = x >> bits, x & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + np.uint64((key * 64 + r) & (2 ** 63 - 1))) & mask)
        x = (left << bits) | right
        out[walking] = x
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def record_size(length: int = LENGTH) -> int:
    """Bytes from one record to the next: number of tokens, the ids, a closing newline."""
    return HEADER + 2 * length + 1


ROWS = "part int, first long, n long, ids binary, counts binary, crcs binary, doc_at binary, docs binary"


def sequences(batches: Iterator[pd.DataFrame], name: str, length: int, row_sequences: int) -> Iterator[pd.DataFrame]:
    """Cuts a partition's stream of documents into sequences; the last one of a row may be shorter."""
    import zstandard

    enc, pack = encoder(name), zstandard.ZstdCompressor(level=LEVEL)
    part = TaskContext.get().partitionId()
    first = 0
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def row():
        nonlocal first, size
        flat = np.concatenate(held)
        if flat.max() > 0xFFFF:
            raise ValueError(f"id {flat.max()} of the vocabulary does not fit the records' 16 bits")
        n = -(-flat.size // length)
        counts = np.full(n, length, dtype=np.uint32)
        counts[-1] = flat.size - (n - 1) * length
        ids = np.zeros(n * length, dtype="<u2")
        ids[: flat.size] = flat
        lens = np.array([x.size for x in held])
        a = (np.cumsum(lens) - lens) // length
        b = (np.cumsum(lens) - 1) // length
        many = b - a + 1
        doc_at = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        crcs = [zlib.crc32(ids[i * length: i * length + c].astype("<u4").tobytes()) for i, c in enumerate(counts.tolist())]
        out = (part, first, n, pack.compress(ids.tobytes()), counts.tobytes(), np.array(crcs, np.uint32).tobytes(),
               doc_at.astype(np.uint32).tobytes(), np.repeat(np.array(owners, np.int64), many).tobytes())
        first += n
        size = 0
        held.clear()
        owners.clear()
        return out

    for pdf in batches:
        texts = pdf["text"].tolist()
        ids = pdf["doc_id"].fillna(-1).to_numpy().astype(np.int64)
        for at in range(0, len(texts), 256):
            some = [None if isinstance(t, float) else t for t in texts[at: at + 256]]
            for doc, x in zip(ids[at: at + 256].tolist(), enc.encode(some)):
                held.append(np.append(x, np.uint32(END)))
                owners.append(doc)
                size += x.size + 1
            if size >= row_sequences * length:
                yield pd.DataFrame([row()], columns=ROWS.replace(",", "").split()[::2])
    if held:
        yield pd.DataFrame([row()], columns=ROWS.replace(",", "").split()[::2])


def to_shards(batches: Iterator[pd.DataFrame], base: np.ndarray, n: int, length: int, shard_sequences: int,
              key: int) -> Iterator[pd.DataFrame]:
    """Splits each stored row by the shards of its sequences' slots."""
    import zstandard

    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL)
    for pdf in batches:
        for part, first, count, raw, counts in zip(*(pdf[c] for c in ("part", "first", "n", "ids", "counts"))):
            slots = feistel(base[part] + first + np.arange(count), n, key)
            order = np.argsort(slots)
            ids = np.frombuffer(unpack.decompress(raw), "<u2").reshape(count, length)
            held = np.frombuffer(counts, np.uint32)
            shard = slots[order] // shard_sequences
            cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            yield pd.DataFrame([(int(shard[a]), slots[order[a:b]].tobytes(), held[order[a:b]].tobytes(),
                                 pack.compress(ids[order[a:b]].tobytes())) for a, b in zip(cuts[:-1], cuts[1:])],
                               columns=["shard", "slots", "counts", "ids"])


def dealt_by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Rows to tasks by the shard number (int) itself: no task gets more than one shard above the mean."""
    return rows.repartitionById(int(min(shards, SHARD_TASKS)), "shard")


def shard_records(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """The records of one shard in slot order, without their closing newline."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    slots = np.frombuffer(b"".join(rows["slots"]), np.int64)
    counts = np.frombuffer(b"".join(rows["counts"]), "<u4")
    ids = np.frombuffer(b"".join([unpack.decompress(x) for x in rows["ids"]]), "<u2").reshape(-1, length)
    order = np.argsort(slots)
    return pd.DataFrame({"shard": int(rows["shard"].iloc[0]), "slot": slots[order],
                         "record": [counts[i].tobytes() + ids[i].tobytes() for i in order.tolist()]})


def slot_table(batches: Iterator[pd.DataFrame], base: np.ndarray, n: int, shard_sequences: int, length: int,
               key: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part, first, count, counts, crcs, doc_at, docs in zip(
                *(pdf[c] for c in ("part", "first", "n", "counts", "crcs", "doc_at", "docs"))):
            slots = feistel(base[part] + first + np.arange(count), n, key)
            cut = np.searchsorted(np.frombuffer(doc_at, np.uint32), np.arange(count + 1))
            owners = np.frombuffer(docs, np.int64)
            yield pd.DataFrame({
                "sequence": base[part] + first + np.arange(count), "slot": slots, "shard": slots // shard_sequences,
                "byte_offset": slots % shard_sequences * record_size(length),
                "n_tokens": np.frombuffer(counts, np.uint32).astype(np.int64),
                "ids_crc32": np.frombuffer(crcs, np.uint32).astype(np.int64),
                "doc_ids": [owners[a:b] for a, b in zip(cut[:-1], cut[1:])]})


def materialise(docs: DataFrame, length: int = LENGTH, key: int = KEY, vocabulary: str = VOCABULARY,
                shard_sequences: int = SHARD_SEQUENCES, row_sequences: int = ROW_SEQUENCES,
                path: str | None = None) -> DataFrame:
    """Writes all texts as fixed-stride shards in training order; returns one row per sequence.

    The documents of a partition form one stream (each text's ids, then the end
    id; a null or empty text is its end id alone) that is cut every ``length``
    tokens. A record is the number of tokens (uint32), ``length`` ids (uint16,
    little-endian, zeros after the last) and a newline. Shard k holds slots k *
    ``shard_sequences`` and on, in ``path``/shard=k; ``path`` defaults to the
    shared folder. Columns: sequence, slot, shard, byte_offset in the shard,
    n_tokens, ids_crc32 (over uint32 ids) and doc_ids of the documents in it (-1
    for a null id). A vocabulary with ids over 65,535 raises. Rows that repeat are documents of their own; an empty table
    gives no rows and no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    rows = written(docs.mapInPandas(lambda it: sequences(it, vocabulary, length, row_sequences), ROWS), "sequences")
    # One number per input partition.
    per_part = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    sizes = np.zeros(max(per_part, default=-1) + 1, dtype=np.int64)
    for part, n in per_part.items():
        sizes[part] = n
    base, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    path = path or scratch_dir(spark, "shards")
    if n:
        shards = -(-n // shard_sequences)
        records = (rows.mapInPandas(lambda it: to_shards(it, base, n, length, shard_sequences, key),
                                    "shard int, slots binary, counts binary, ids binary")
                   .transform(lambda df: dealt_by_shard(df, shards)).groupBy("shard")
                   .applyInPandas(lambda g: shard_records(g, length), "shard long, slot long, record binary"))
        # The text writer puts out the bytes as they are and ends each record with a newline.
        (records.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
         .write.partitionBy("shard").text(path))
    return rows.drop("ids").mapInPandas(
        lambda it: slot_table(it, base, n, shard_sequences, length, key),
        "sequence long, slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>")


def read_shard(spark: SparkSession, path: str, shard: int, from_slot: int = 0, length: int = LENGTH) -> DataFrame:
    """(slot_in_shard, ids) of one shard in order, from a place on: what a resumed training run reads."""
    def cut(batches):
        step = record_size(length)
        for pdf in batches:
            for raw in pdf["content"]:
                for i in range(from_slot, len(raw) // step):
                    n = int.from_bytes(raw[i * step: i * step + HEADER], "little")
                    ids = np.frombuffer(raw, "<u2", n, i * step + HEADER)
                    yield pd.DataFrame({"slot_in_shard": [i], "ids": [ids.astype(np.int32)]})

    return (spark.read.format("binaryFile").load(f"{path.rstrip('/')}/shard={shard}").select("content")
            .mapInPandas(cut, "slot_in_shard long, ids array<int>"))
