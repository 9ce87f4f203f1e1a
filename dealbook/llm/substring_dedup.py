"""Substring deduplication with compressed full-text indexes.

A window is WINDOW consecutive words of one document. A window whose word
sequence also starts earlier (smaller doc_id, or earlier in the same document)
is repeated, and every word under a repeated window is removed.

Work is cut by content, so each index sees all it has to compare:

1. Equal texts are told by their hash: all but the one of smallest id repeat as
   a whole, and only that one goes on.
2. Consecutive windows with the same least GRAM-word hash form a segment; equal
   windows have the same least hash, so they meet in the same shard. The hashes
   are counted first. One that a single segment has can repeat in that segment
   alone, where the words go round; a segment without such a window stays where
   it is. One that very many have is hot, and its windows go out one by one
   under the hash of all their words, so no shard grows with it.
3. Each shard indexes its distinct segments (Burrows-Wheeler transform in a
   wavelet tree) and streams them through: backward search gives for every
   window the interval of its occurrences, and with it the earliest.
4. The repeated windows go back to their documents.

Copies of a segment within a slice of texts are settled there, so a passage of
very many documents reaches its shard once a slice, not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches, written
from dealbook.llm.fm_index import earliest
from dealbook.llm.shingles import mix
from dealbook.llm.words import Words, rolled, slices, sliding_min

WINDOW = 20
#: Words of the hashes whose least routes a window.
GRAM = 5
#: Text bytes per shard, and words that one index holds about.
SHARD_BYTES = 8_000_000
INDEX_WORDS = 1_500_000
#: Text bytes whose hashes one bucket counts.
BUCKET_BYTES = 32_000_000
#: A hash is hot from so many segments on, or from one in HOT_PART bytes of all text if that is more, so the list
#: of hot ones that all tasks get has at most HOT_PART entries (8 bytes each), at any size.
HOT_SEGMENTS = 5_000
HOT_PART = 1 << 22
_FAR = np.int64(1) << 62

_META = ["known", "id", "mark", "start", "windows"]
GRAMS = "bucket long, settled boolean, entries binary"
CUT = "shard long, settled boolean, words binary, meta binary"
REPEATED = "known boolean, id long, mark long, start long, windows long"


class Segments:
    """The segments of a slice of documents; those whose least hash is in ``shared`` if that is given.

    ``shared`` holds sorted hashes for each text. ``first`` is a segment's first word in ``words``; ``windows`` counts its
    windows; ``gram`` is the least hash, ``key`` identifies its words, and ``round`` tells whether one of its windows
    comes again within the next WINDOW words, as windows of one segment can.
    """

    def __init__(self, texts, window: int, gram: int, hot: np.ndarray, shared: list[np.ndarray] | None = None):
        self.words = w = Words(texts)
        last = w.cut[1:][w.text] - window
        at = np.flatnonzero(np.arange(len(w)) <= last)
        least = sliding_min(mix(rolled(w.hash, gram)), window - gram + 1)[at]
        if shared is not None:
            keep = _among(least, w.text[at], shared)
            at, least = at[keep], least[keep]
        full = rolled(w.hash, window)[at]
        begin = np.ones(at.size, dtype=bool)
        begin[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
        if hot.size:
            slot = np.minimum(np.searchsorted(hot, least), hot.size - 1)
            lone = hot[slot] == least
            begin |= lone
            begin[1:] |= lone[:-1]
            least = np.where(lone, mix(full), least)
        # At most WINDOW windows a segment: its first and last window then cover all its words.
        run = np.flatnonzero(begin)
        begin |= (np.arange(at.size) - np.repeat(run, np.diff(np.append(run, at.size)))) % window == 0
        run = np.flatnonzero(begin)
        self.windows = np.diff(np.append(run, at.size))
        self.first, self.gram = at[run], least[run]
        self.text = w.text[self.first]
        self.start = self.first - w.cut[self.text]
        self.key = mix(full[run] + mix(full[run + self.windows - 1] ^ self.windows.astype(np.uint64)))
        again = np.zeros(at.size, dtype=bool)
        for by in range(1, min(window, at.size)):
            again[:-by] |= (full[by:] == full[:-by]) & (at[by:] - at[:-by] == by)
        self.round = np.logical_or.reduceat(again, run) if run.size else again


def _among(values: np.ndarray, text: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which values lie in the set of their text; values come text by text."""
    out = np.zeros(values.size, dtype=bool)
    cuts = np.searchsorted(text, np.arange(len(sets) + 1))
    for k, own in enumerate(sets):
        if own.size and cuts[k] < cuts[k + 1]:
            part = values[cuts[k]: cuts[k + 1]]
            slot = np.minimum(np.searchsorted(own, part), own.size - 1)
            out[cuts[k]: cuts[k + 1]] = own[slot] == part
    return out


def document_grams(batches: Iterator[pd.DataFrame], window: int, gram: int, buckets: int) -> Iterator[pd.DataFrame]:
    """The least hashes of a slice's segments, one entry each, dealt to buckets by hash.

    An entry has the hash, the mark of a text that has it, how many segments
    do, and whether it is shared here: by more than one, or by windows of one
    segment that are alike. Where it is, the texts need not ask: a settled row
    has their (mark, hash) pairs. So a hash sends one entry a slice, in however
    many texts it is; rows are at most entries.
    """
    for pdf in slices(batches):
        pdf = pdf.drop_duplicates("mark")
        s = Segments(pdf["text"].tolist(), window, gram, np.empty(0, np.uint64))
        if not s.gram.size:
            continue
        marks = pdf["mark"].to_numpy().astype(np.int64)[s.text]
        order = np.lexsort((s.text, s.gram))
        grams, marks = s.gram[order], marks[order]
        begin = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        n = np.diff(np.append(begin, grams.size))
        shared = (n > 1) | np.logical_or.reduceat(s.round[order], begin)
        pairs = np.column_stack((marks, grams.view(np.int64)))[np.repeat(shared, n)]
        if pairs.size:
            pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]
        entries = np.column_stack((grams[begin].view(np.int64), marks[begin], n, shared)).astype(np.int64)
        bucket = _dealt(grams[begin], buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        rows = [(int(bucket[order[a]]), False, _pack(entries[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
        if pairs.size:
            rows.append((int(bucket[0]), True, _pack(pairs)))
        yield pd.DataFrame(rows, columns=["bucket", "settled", "entries"])


def shared_grams(batches: Iterator[pd.DataFrame], hot_segments: int) -> Iterator[pd.DataFrame]:
    """Of the buckets of a partition, in order: (mark, gram) of the texts whose hash is shared.

    A row without a mark tells of a hot hash, with the number of its segments.
    """
    def close(entries):
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        begin = np.flatnonzero(np.concatenate(([True], entries[1:, 0] != entries[:-1, 0])))
        size = np.diff(np.append(begin, len(entries)))
        n, many = np.add.reduceat(entries[:, 2], begin), np.maximum.reduceat(entries[:, 3], begin)
        ask = entries[np.repeat((size > 1) | (many > 0), size) & (entries[:, 3] == 0)]
        hot = n >= hot_segments
        return pd.DataFrame({
            "mark": pd.array([*ask[:, 1].tolist(), *[None] * int(hot.sum())], dtype="Int64"),
            "gram": np.concatenate((ask[:, 0], entries[begin[hot], 0])),
            "n": np.concatenate((np.zeros(len(ask), np.int64), n[hot]))})

    parts, now = [], None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.settled:
                pairs = _unpack(row.entries, 2)
                yield pd.DataFrame({"mark": pd.array(pairs[:, 0], dtype="Int64"), "gram": pairs[:, 1], "n": 0})
                continue
            if parts and row.bucket != now:
                yield close(np.concatenate(parts))
                parts = []
            now = row.bucket
            parts.append(_unpack(row.entries, 4))
    if parts:
        yield close(np.concatenate(parts))


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(meta: np.ndarray) -> bytes:
    """Rows of 64-bit numbers, byte by byte of each column, compressed."""
    import zstandard

    raw = np.ascontiguousarray(meta.T).view(np.uint8).reshape(meta.shape[1], -1, 8)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.transpose(0, 2, 1)).tobytes())


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.int64)[:, :, 0].T


def _settle(key: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to go on with (the first occurrence of each key), and rows settled as repeated.

    Rows of a key that tie for the first place (rows of one id) all go on, one of each mark.
    """
    order = np.lexsort((meta[:, 2], meta[:, 3], meta[:, 1], ~meta[:, 0], key))
    k, place = key[order], meta[order][:, [0, 1, 3]]
    fresh = np.ones(order.size, dtype=bool)
    fresh[1:] = k[1:] != k[:-1]
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    tied = (place == place[lead]).all(axis=1)
    again = np.zeros(order.size, dtype=bool)
    again[1:] = ~fresh[1:] & (meta[order][1:] == meta[order][:-1]).all(axis=1)
    return order[tied & ~again], order[~tied & ~again]


def cut_segments(batches: Iterator[pd.DataFrame], window: int, gram: int, shards: int,
                 hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """Per slice and shard one row of its segments, and one row of the occurrences settled here."""
    import zstandard

    for pdf in slices(batches):
        shared = [np.sort(np.asarray(g, dtype=np.int64).view(np.uint64)) for g in pdf["grams"]]
        s = Segments(pdf["text"].tolist(), window, gram, hot, shared)
        if not s.first.size:
            continue
        known = pdf["doc_id"].notna().to_numpy()
        ids = pdf["doc_id"].fillna(0).to_numpy().astype(np.int64)
        marks = pdf["mark"].to_numpy().astype(np.int64)
        meta = np.column_stack((known[s.text], ids[s.text], marks[s.text], s.start, s.windows)).astype(np.int64)
        keep, settled = _settle(s.key, meta)
        shard = _dealt(s.gram[keep], shards)
        order = np.lexsort((keep, shard))
        keep, shard = keep[order], shard[order]
        last = s.first + s.windows + (window - 2)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = keep[a:b]
            words = b" ".join([s.words.span(i, j) for i, j in zip(s.first[own].tolist(), last[own].tolist())])
            rows.append((int(shard[a]), False, squeeze(words), _pack(meta[own])))
        if settled.size:
            rows.append((int(mix(s.key[settled[:1]])[0] % np.uint64(shards)), True, b"", _pack(meta[settled])))
        yield pd.DataFrame(rows, columns=["shard", "settled", "words", "meta"])


def _repeated(meta: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(meta, columns=_META)
    out["known"] = out["known"].astype(bool)
    return out


def _numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Numbers from 1 of words, equal words alike; ``known`` grows."""
    return np.fromiter((known.setdefault(w, len(known) + 1) for w in words), dtype=np.int64, count=len(words))


def distinct(text: np.ndarray, meta: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and rows of the first occurrence of each segment, in document order, and the rows settled as repeated.

    ``text`` holds the words of the segments of ``meta`` one after the other.
    """
    length = meta[:, 4] + (window - 1)
    first = np.cumsum(length) - length
    keep, settled = _settle(rolled_sums(mix(text.astype(np.uint64)), first, length), meta)
    keep = keep[np.lexsort((meta[keep, 3], meta[keep, 1], ~meta[keep, 0]))]
    step = np.repeat(first[keep] - (np.cumsum(length[keep]) - length[keep]), length[keep])
    return text[np.arange(step.size) + step], meta[keep], meta[settled]


def search_shard(text: np.ndarray, meta: np.ndarray, window: int) -> np.ndarray:
    """Repeated windows of a shard: rows as ``meta``, one per stretch of them."""
    text, meta, settled = distinct(text, meta, window)
    out = [settled]
    length = meta[:, 4] + (window - 1)
    begin = np.cumsum(length + 1) - length - 1
    place = np.arange(text.size + length.size) - np.repeat(begin, length + 1)
    end = place == np.repeat(length, length + 1)
    seq = np.zeros(place.size, dtype=np.int64)
    seq[~end] = text
    starts = place < np.repeat(meta[:, 4], length + 1)
    owner = np.repeat(np.arange(length.size), length + 1)[starts]
    rank = _ranked(meta[owner, 0], meta[owner, 1], meta[owner, 3] + place[starts])
    order = np.full(seq.size, _FAR)
    order[starts] = rank
    found = earliest(seq, begin, length, order, window)[starts] < rank
    # Stretches of repeated windows of one segment.
    where = np.flatnonzero(found)
    if where.size:
        fresh = np.ones(where.size, dtype=bool)
        fresh[1:] = (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]])
        lead = np.flatnonzero(fresh)
        rows = meta[owner[where[lead]]].copy()
        rows[:, 3] += place[starts][where[lead]]
        rows[:, 4] = np.diff(np.append(lead, where.size))
        out.append(rows)
    return np.concatenate(out)


def rolled_sums(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit hashes of stretches of h that lie one after the other and cover it."""
    if not first.size:
        return np.empty(0, np.uint64)
    place = np.arange(h.size) - np.repeat(first, length)
    return mix(np.add.reduceat(mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
               + length.astype(np.uint64))


def _ranked(known: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of each window by (doc_id, start), nulls last; windows of one place tie."""
    order = np.lexsort((start, ids, ~known))
    fresh = np.zeros(order.size, dtype=np.int64)
    fresh[1:] = ((ids[order][1:] != ids[order][:-1]) | (start[order][1:] != start[order][:-1])
                 | (known[order][1:] != known[order][:-1]))
    out = np.empty(order.size, dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


def search_shards(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Repeated windows of the shards of a partition, whose rows come in the order of the shards.

    Copies from many slices are settled as they come, so a task holds the distinct segments of its shard.
    """
    import zstandard

    known: dict[bytes, int] = {}
    texts, metas, size, room, now = [], [], 0, 2 * INDEX_WORDS, None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            meta = _unpack(row.meta, len(_META))
            if row.settled:
                yield _repeated(meta)
                continue
            if size >= INDEX_WORDS and row.shard != now:
                yield _repeated(search_shard(np.concatenate(texts), np.concatenate(metas), window))
                known, texts, metas, size, room = {}, [], [], 0, 2 * INDEX_WORDS
            elif size >= room:
                text, kept, settled = distinct(np.concatenate(texts), np.concatenate(metas), window)
                yield _repeated(settled)
                texts, metas, size = [text], [kept], text.size
                room = max(room, 2 * size)
            now = row.shard
            texts.append(_numbered(zstandard.ZstdDecompressor().decompress(row.words).split(), known)
                         .astype(np.int32))
            metas.append(meta)
            size += texts[-1].size
    if texts:
        yield _repeated(search_shard(np.concatenate(texts), np.concatenate(metas), window))


def _cover(n: int, start: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under a window of the stretches."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows + (window - 1), -1)
    return np.cumsum(edge)[:n] > 0


def remove_words(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, copy, start, windows in zip(pdf["text"], pdf["copy"], pdf["starts"], pdf["windows"]):
            words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
            kept = words
            if copy:
                kept = words if len(words) < window else []
            elif start is not None and len(start):
                gone = _cover(len(words), np.asarray(start), np.asarray(windows), window)
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])
        out.insert(0, "doc_id", pd.array(pdf["doc_id"].tolist(), dtype="Int64"))
        yield out


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark (hash of the text) and copy: whether an equal text has a smaller id (null the largest)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    firsts = rows.groupBy("mark").agg(F.min("doc_id").alias("first"))
    # A left join, so that the test of ``copy`` cannot become a join key: both uses share one exchange by mark.
    return rows.join(firsts, "mark", "left").select("doc_id", "text", "mark",
                                            (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("copy"))


def repeated_windows(docs: DataFrame, rows: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     hot_segments: int = HOT_SEGMENTS, shard_bytes: int = SHARD_BYTES,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Stretches of windows that also start earlier: (known, id, mark, start, windows).

    ``rows`` are those of ``_marked(docs)``; copies take no part. ``id`` is the
    doc_id (0 and ``known`` false for null), ``start`` the first window's
    first word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # At most size / least entries, see HOT_PART.
    least = max(hot_segments, size // HOT_PART)
    buckets = -(-size // bucket_bytes) or 1
    grams = (docs.select("text", F.xxhash64("text").alias("mark"))
             .mapInPandas(lambda b: document_grams(b, window, gram, buckets), GRAMS)
             .repartition("bucket").sortWithinPartitions("bucket")
             .mapInPandas(lambda b: shared_grams(b, least), "mark long, gram long, n long"))
    grams = written(grams, "shared-grams")
    hot = np.sort(np.array([r["gram"] for r in grams.where("mark is null").select("gram").collect()],
                           dtype=np.int64).view(np.uint64))
    hot = spark.sparkContext.broadcast(hot)
    shards = -(-size // shard_bytes) or 1
    shared = grams.where("mark is not null").groupBy("mark").agg(F.collect_set("gram").alias("grams"))
    cut = (rows.join(shared, "mark").where("not copy").select("doc_id", "text", "mark", "grams")
           .mapInPandas(lambda b: cut_segments(b, window, gram, shards, hot.value), CUT))
    return (cut.repartition("shard").sortWithinPartitions("shard")
            .mapInPandas(lambda b: search_shards(b, window), REPEATED))


def remove_repeats(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """Documents without the words of repeated windows.

    Returns doc_id, n_words, n_removed and kept_text (the words that stay,
    joined by one space): one row per row of ``docs``, which needs doc_id and
    text; other columns are ignored. Words are separated by space and 0x09-0x0D
    and otherwise unchanged; a null, empty or blank text has none, and a document with fewer
    words than a window keeps all. Rows of one doc_id count as one document:
    windows of the same start tie, so equal rows get equal results. A null
    doc_id comes after all others. Results are whole at any text length; equal
    texts and copies of a segment are told by 64-bit hashes, windows of
    different segments by their words. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = _marked(docs)
    found = (repeated_windows(docs, rows, window, **how).groupBy("mark")
             .agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows")))
    return (rows.join(found, "mark", "left").select("doc_id", "text", "copy", "starts", "windows")
            .mapInPandas(lambda b: remove_words(b, window),
                         "doc_id long, n_words long, n_removed long, kept_text string"))


def kept_digests(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` with the SHA-256 of each kept text in its place."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed",
                                       F.sha2("kept_text", 256).alias("kept_sha256"))


REMOVE_REPEATS_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
windows AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS d, i, hash_key AS k
            FROM (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS hash_key
                  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20))),
firsts AS (SELECT k, d, min(i) AS i FROM windows GROUP BY k, d QUALIFY row_number() OVER (PARTITION BY k ORDER BY d) = 1),
again AS (SELECT w.r, w.i FROM windows w JOIN firsts f ON w.k = f.k WHERE w.d > f.d OR w.i > f.i),
marked AS (SELECT w.r, w.word, w.i,
                  max(CASE WHEN a.r IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.r ORDER BY w.i
                      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
           FROM words w LEFT JOIN again a ON w.r = a.r AND w.i = a.i),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t
         FROM marked GROUP BY r)
SELECT d.doc_id, len(d.ws) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.r = k.r
"""
