"""N-gram Jaccard join by vertical partitioning of the n-gram order.

A document is its set of distinct word n-grams, as 64-bit hashes. The global
order of n-grams is cut into fragments, so each document becomes one segment
per fragment, and fragments work separately:

1. Each fragment counts in how many distinct sets each of its n-grams lies and
   tells every set how many of its n-grams another set has. Summed over the
   fragments this drops every set that cannot reach the threshold with any.
2. For the sets that remain, n-grams are ordered by exact frequency, rare
   first; sets that share an n-gram of their prefixes go to one cluster.
3. Cluster blocks are cut vertically again. Each (block pair, fragment) counts
   partial overlaps; the counts are summed per pair and compared.

Equal sets are one node throughout, so groups of copies cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.common import components, small_batches, written
from dealbook.llm.shingles import mix, shingle_sets

WIDTH = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Text bytes per fragment of the first cut (about six bytes make an n-gram).
FRAGMENT_BYTES = 16_000_000
#: Characters of text whose n-grams a task holds at a time.
SLICE_CHARS = 2_000_000
#: Documents per group that sums the fragments' shared counts.
SUM_DOCS = 200_000
#: Groups of fragments that a slice is cut into at most; more fragments are cut again from many slices together.
FAN_OUT = 1024
#: Bytes that the second cut takes together.
SPLIT_BYTES = 16_000_000
#: An n-gram is frequent if more sets than HOT_LEAST, or than one in HOT_PART of all n-grams, hold it: a list of at
#: most HOT_PART entries of 16 bytes.
HOT_LEAST, HOT_PART = 500, 1 << 20
#: Sets in one block of a cluster, and fragments of the second cut.
BLOCK_SETS = 1024
FRAGMENTS = 8


def needed(a, b, percent: int = PERCENT):
    """Smallest intersection of sets of sizes a and b that links them."""
    return -(-(percent * (a + b)) // (100 + percent))


def fragment_of(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """Which range of the hash order each n-gram lies in."""
    return ((tokens >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set: two independent sums over its n-grams."""
    lens = np.array([s.size for s in sets], dtype=np.int64)
    if not lens.sum():
        return np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    flat = np.concatenate(sets)
    some = np.flatnonzero(lens)  # reduceat knows no empty runs
    starts = (np.cumsum(lens) - lens)[some]

    def key(salt):
        total = np.zeros(lens.size, dtype=np.uint64)
        total[some] = np.add.reduceat(mix(flat + np.uint64(salt)), starts)
        return mix(total + lens.astype(np.uint64)).view(np.int64)

    return key(0x1234567), key(0x89ABCDE)


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut to about SLICE_CHARS characters of text each (one text at least)."""
    for pdf in batches:
        part = pdf["text"].str.len().fillna(0).cumsum() // SLICE_CHARS
        for _, rows in pdf.groupby(part.to_numpy(), sort=True):
            yield rows


def low_bits(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """The 32 bits below the fragment number."""
    return (tokens * np.uint64(fragments) >> np.uint64(32)).astype(np.uint32)


def _rows_by(part: np.ndarray, parts: np.ndarray, owners: np.ndarray, tokens: np.ndarray, refs: np.ndarray,
             sizes: np.ndarray) -> dict[int, tuple]:
    """For each of ``parts`` its segments (refs, sizes, lens, tokens); ``owners`` index refs and sizes."""
    order = np.lexsort((owners, part))
    part, owners, tokens = part[order], owners[order], tokens[order]
    out = {}
    for f, a, b in zip(parts.tolist(), np.searchsorted(part, parts), np.searchsorted(part, parts, "right")):
        runs = np.flatnonzero(np.diff(owners[a:b], prepend=-1))
        own = owners[a:b][runs]
        out[f] = (refs[own].tobytes(), sizes[own].astype(np.uint32).tobytes(),
                  np.diff(np.append(runs, b - a)).astype(np.uint32).tobytes(), tokens[a:b].tobytes())
    return out


def segments(batches: Iterator[pd.DataFrame], width: int, fragments: int, step: int) -> Iterator[pd.DataFrame]:
    """Per slice and group of ``step`` fragments one row with the segments of the slice's distinct sets.

    An n-gram that several sets of the slice have is shared, whatever the
    others hold: those sets are told so here (``told``: set, its size, how many
    such n-grams), and the n-gram goes out once (``many``). So one that very
    many sets have is one entry a slice, and only n-grams of a single set go
    out with it. The rows also carry the slice's documents (id, set key, set
    size), dealt over the rows, so one pass over the texts gives all. Within a
    fragment 32 more bits tell n-grams apart; a rare clash only makes an
    n-gram look shared, which keeps a set for the exact steps.
    """
    groups = -(-fragments // step)
    for pdf in slices(batches):
        sets = shingle_sets(pdf["text"].tolist(), width)
        hi, lo = set_keys(sets)
        size = np.array([s.size for s in sets], dtype=np.int64)
        known = pdf["doc_id"].notna().to_numpy()
        ids = pdf["doc_id"].fillna(0).to_numpy().astype(np.int64)
        docs = np.column_stack((ids, known, hi, lo, size)).astype(np.int64)
        _, first = np.unique(hi, return_index=True)
        first = first[size[first] > 0]
        flat = np.concatenate([sets[i] for i in first]) if first.size else np.empty(0, np.uint64)
        owner = np.repeat(first, size[first])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        same = flat[1:] == flat[:-1]
        common = np.zeros(flat.size, dtype=bool)
        common[1:] |= same
        common[:-1] |= same
        local = np.bincount(owner[common], minlength=len(sets))
        some = np.flatnonzero(local)
        told = np.column_stack((hi[some], size[some], local[some])).astype(np.int64)
        many = np.unique(flat[common])
        value = (lambda x: low_bits(x, fragments)) if step == 1 else (lambda x: x)
        many_at = fragment_of(many, fragments) // step
        alone, owner = flat[~common], owner[~common]
        part = fragment_of(alone, fragments) // step
        used = np.unique(np.concatenate((part, many_at)))
        if not used.size:
            used = np.zeros(1, dtype=np.int64)
        rows = _rows_by(part, used, owner, value(alone), hi, size)
        deal, deal_told = np.arange(len(docs)) % used.size, np.arange(len(told)) % used.size
        yield pd.DataFrame([
            (f, *rows[f], value(many[many_at == f]).tobytes(), told[deal_told == i].tobytes(),
             docs[deal == i].tobytes()) for i, f in enumerate(used.tolist())],
            columns=[c.split()[0] for c in SEGMENTS.split(", ")])


SEGMENTS = "frag int, refs binary, sizes binary, lens binary, tokens binary, many binary, told binary, docs binary"
SHARED = "bucket int, doc_id long, hi long, lo long, n long, told binary"


def split_segments(batches: Iterator[pd.DataFrame], fragments: int, step: int) -> Iterator[pd.DataFrame]:
    """Second level of the cut: rows of groups of ``step`` fragments, in the order of the groups, to rows of fragments.

    Rows of many slices are cut together, so the rows that leave grow with the
    n-grams and not with slices times fragments.
    """
    held: list = []
    size = 0

    def cut():
        refs, sizes, lens = (np.frombuffer(b"".join(r[k] for r in held), kind) for k, kind in (
            (1, np.int64), (2, np.uint32), (3, np.uint32)))
        tokens, many = (np.frombuffer(b"".join(r[k] for r in held), np.uint64) for k in (4, 5))
        part, many_at = fragment_of(tokens, fragments), fragment_of(many, fragments)
        used = np.unique(np.concatenate((part, many_at)))
        used = used if used.size else np.array([held[0][0] * step])
        rows = _rows_by(part, used, np.repeat(np.arange(refs.size), lens), low_bits(tokens, fragments), refs, sizes)
        told, docs = (b"".join(r[k] for r in held) for k in (6, 7))
        out = pd.DataFrame([(f, *rows[f], low_bits(many[many_at == f], fragments).tobytes(), told * (i == 0),
                             docs * (i == 0)) for i, f in enumerate(used.tolist())],
                           columns=[c.split()[0] for c in SEGMENTS.split(", ")])
        held.clear()
        return out

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if held and (row.frag != held[0][0] or size >= SPLIT_BYTES):
                yield cut()
                size = 0
            held.append(tuple(row))
            size += len(row.tokens) + len(row.docs)
    if held:
        yield cut()


def shared_counts(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One fragment: for each set how many of its n-grams lie in another set too.

    Only segments of which at least half is shared are told. A set that can
    link at p percent has at most 100 - p percent of its n-grams unshared; its
    other segments have more unshared than shared n-grams, so they hold fewer
    shared ones than that, and the told segments add up to 2p - 100 percent or
    more (what a slice has told is a segment of its own, shared as a whole).
    The counts leave as one row (``told``: set, its size, shared n-grams) per
    bucket of sets that has some; documents ride along as rows without a bucket.
    """
    docs = np.frombuffer(b"".join(rows["docs"]), np.int64).reshape(-1, 5)
    told = [np.frombuffer(b"".join(rows["told"]), np.int64).reshape(-1, 3)]
    refs = np.frombuffer(b"".join(rows["refs"]), np.int64)
    if refs.size:
        size = np.frombuffer(b"".join(rows["sizes"]), np.uint32)
        lens = np.frombuffer(b"".join(rows["lens"]), np.uint32).astype(np.int64)
        tokens = np.frombuffer(b"".join(rows["tokens"]), np.uint32)
        many = np.unique(np.frombuffer(b"".join(rows["many"]), np.uint32))
        # Equal sets of different slices count once.
        names, first = np.unique(refs, return_index=True)
        keep = np.zeros(refs.size, dtype=bool)
        keep[first] = True
        # N-gram in the high half, set in the low half; sorted, equal n-grams lie side by side.
        both = tokens[np.repeat(keep, lens)].astype(np.uint64) << np.uint64(32)
        both |= np.repeat(np.searchsorted(names, refs[keep]), lens[keep]).astype(np.uint64)
        both.sort()
        high = (both >> np.uint64(32)).astype(np.uint32)
        same = high[1:] == high[:-1]
        common = np.zeros(both.size, dtype=bool)
        common[1:] |= same
        common[:-1] |= same
        if many.size:
            slot = np.minimum(np.searchsorted(many, high), many.size - 1)
            common |= many[slot] == high
        counts = np.bincount((both[common] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=names.size)
        some = np.flatnonzero((counts > 0) & (2 * counts >= lens[first]))
        told.append(np.column_stack((names[some], size[first][some], counts[some])).astype(np.int64))
    told = np.concatenate(told)
    bucket = (told[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    return pd.concat([
        pd.DataFrame({"doc_id": pd.Series(docs[:, 0], dtype="Int64").where(docs[:, 1] == 1), "hi": docs[:, 2],
                      "lo": docs[:, 3], "n": docs[:, 4]}).astype("Int64"),  # before nulls make floats of 64-bit keys
        pd.DataFrame([(int(bucket[order[a]]), told[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])],
                     columns=["bucket", "told"]).astype({"bucket": "Int64"})], ignore_index=True).reindex(
        columns=[c.split()[0] for c in SHARED.split(", ")]).astype(
        {c: "Int64" for c in ("bucket", "doc_id", "hi", "lo", "n")})


def hopeful_sets(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Sums the counts of one bucket over the fragments; the sets that may still link."""
    told = np.frombuffer(b"".join(rows["told"]), np.int64).reshape(-1, 3)
    names, first, back = np.unique(told[:, 0], return_index=True, return_inverse=True)
    shared = np.bincount(back, weights=told[:, 2], minlength=names.size)
    return pd.DataFrame({"hi": names[100 * shared >= (2 * percent - 100) * told[first, 1]]})


def set_segments(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Per set and fragment of the second cut one row: its n-grams there."""
    for pdf in slices(batches):
        rows = []
        sets = shingle_sets(pdf["text"].tolist(), width)
        for ref, s in zip(set_keys(sets)[0].tolist(), sets):
            frag = fragment_of(s, FRAGMENTS)
            cuts = np.searchsorted(frag, np.arange(FRAGMENTS + 1))
            rows += [(ref, s.size, f, s[a:b].tobytes())
                     for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        yield pd.DataFrame(rows, columns=["ref", "n", "frag", "tokens"])


def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by n-gram range in, the segments' n-grams out as (token, ref, n)."""
    for pdf in batches:
        lens = (pdf["tokens"].str.len() // 8).to_numpy()
        yield pd.DataFrame({"token": np.frombuffer(b"".join(pdf["tokens"]), np.int64),
                            "ref": np.repeat(pdf["ref"].to_numpy(), lens),
                            "n": np.repeat(pdf["n"].to_numpy(), lens)})


def partial_overlaps(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One fragment of one block pair: for each left set the right sets it overlaps, and by how much.

    A pair is left out when its difference in this fragment alone exceeds what
    the threshold allows the whole sets; its sum then stays short of the
    threshold, as it should.
    """
    rows = rows.drop_duplicates("ref")  # a repeated row of the table brings a set twice
    left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
    one_block = rows["i"].iloc[0] == rows["j"].iloc[0]
    out = []
    if len(left) and len(right):
        r_tokens = np.frombuffer(b"".join(right["tokens"]), np.uint64)
        r_len = (right["tokens"].str.len() // 8).to_numpy()
        r_owner = np.repeat(np.arange(len(right)), r_len)
        order = np.argsort(r_tokens, kind="stable")
        r_tokens, r_owner = r_tokens[order], r_owner[order]
        r_ref, r_n, r_cluster = (right[c].to_numpy() for c in ("ref", "n", "cluster"))
        for ref, n, cluster, raw in zip(left["ref"], left["n"], left["cluster"], left["tokens"]):
            s = np.frombuffer(raw, np.uint64)
            a, b = np.searchsorted(r_tokens, s, "left"), np.searchsorted(r_tokens, s, "right")
            hits = b - a
            total = int(hits.sum())
            if not total:
                continue
            step = np.ones(total, dtype=np.int64)
            some = hits > 0
            ends = np.cumsum(hits[some])
            step[0] = a[some][0]
            step[ends[:-1]] = a[some][1:] - (a[some][:-1] + hits[some][:-1] - 1)
            count = np.bincount(r_owner[np.cumsum(step)], minlength=len(right))
            j = np.flatnonzero(count)
            # Each unordered pair once, only within a cluster.
            j = j[((r_ref[j] > ref) | (not one_block)) & (r_cluster[j] == cluster)]
            allowed = n + r_n[j] - 2 * needed(n, r_n[j], percent)
            j = j[s.size + r_len[j] - 2 * count[j] <= allowed]
            if j.size:
                out.append((ref, n, r_ref[j].tobytes(), count[j].astype(np.uint32).tobytes()))
    pdf = pd.DataFrame(out, columns=["ref", "n", "others", "counts"])
    return pdf.astype({"ref": "int64", "n": "int64"}).assign(
        **{c: rows[c].iloc[0] for c in ("bucket", "i", "j")})[["bucket", "i", "j", "ref", "n", "others", "counts"]]


def summed_links(rows: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Sums the partial overlaps per pair of one block pair; returns a forest that spans the links."""
    empty = pd.DataFrame({"a": [], "b": []}).astype("int64")
    if rows.empty or members.empty:
        return empty
    members = members.drop_duplicates("ref").sort_values("ref")
    right, size = members["ref"].to_numpy(), members["n"].to_numpy()
    nodes = np.union1d(right, rows["ref"].to_numpy())
    back = np.searchsorted(nodes, right)
    label = np.arange(nodes.size)
    for r, part in rows.groupby("ref"):
        others = np.searchsorted(right, np.frombuffer(b"".join(part["others"]), np.int64))
        counts = np.bincount(others, weights=np.frombuffer(b"".join(part["counts"]), np.uint32),
                             minlength=right.size)
        j = np.flatnonzero(counts)
        n = int(part["n"].iloc[0])
        j = j[counts[j] >= needed(n, size[j], percent)]
        if j.size:
            groups = np.unique(label[np.append(back[j], np.searchsorted(nodes, r))])
            if groups.size > 1:
                label[np.isin(label, groups)] = groups[0]
    edges = np.flatnonzero(label != np.arange(label.size))
    return pd.DataFrame({"a": nodes[edges], "b": nodes[label[edges]]}) if edges.size else empty


def jaccard_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                    fragment_bytes: int = FRAGMENT_BYTES, block_sets: int = BLOCK_SETS,
                    fan_out: int = FAN_OUT) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower
    case. Documents without words or with a null text have an empty set and
    link with nothing; one with fewer than ``width`` words has its whole word
    sequence as its one n-gram. Rows with a null doc_id get a null component
    and lend none. Rows that repeat a doc_id are linked by their own texts and
    keep a row each. Texts of any length are read whole. Other columns are not
    read. n-grams are compared by 64-bit hashes. ``percent`` must be over 50:
    the bounds by which sets are dropped hold only there.
    """
    if not 50 < percent <= 100:
        raise ValueError(f"percent must be over 50 and at most 100, not {percent}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, count = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size, buckets = size or 0, max(1, -(-count // SUM_DOCS))
    fragments = int(max(1, -(-size // fragment_bytes)))
    step = -(-fragments // fan_out)
    small_batches(spark)
    rows = docs.mapInPandas(lambda it: segments(it, width, fragments, step), SEGMENTS)
    if step > 1:
        rows = (rows.repartition("frag").sortWithinPartitions("frag")
                .mapInPandas(lambda it: split_segments(it, fragments, step), SEGMENTS))
    first = written(rows.groupBy("frag").applyInPandas(lambda g: shared_counts(g, buckets), SHARED), "shared")
    sets = first.where("bucket is null").select("doc_id", "hi", "lo", "n")
    hopeful = (first.where("bucket is not null").select("bucket", "told")
               .groupBy("bucket").applyInPandas(lambda g: hopeful_sets(g, percent), "hi long"))
    # One document of each set stands for it; ``ref`` is the key of the set.
    classes = sets.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("first"))
    wanted = written(classes.join(hopeful, "hi").where("first is not null").select("first").distinct(), "hopeful")
    # A doc_id may have several rows, of one set or of many: a set's segments stay once.
    cut = written(docs.join(wanted, F.col("doc_id") == F.col("first")).select("text").mapInPandas(
        lambda it: set_segments(it, width), "ref long, n long, frag int, tokens binary")
        .dropDuplicates(["ref", "frag"]), "segments")

    # Exact frequency order among the remaining sets, rare first; the prefix needs only shared n-grams.
    tokens = cut.select("tokens", "ref", "n").mapInPandas(frequencies, "token long, ref long, n long")
    df = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    # Frequent n-grams get theirs from a list of at most HOT_PART entries; the others join without a hot key.
    n_tokens = df.agg(F.sum("df")).first()[0] or 0
    often = F.col("df") > max(HOT_LEAST, n_tokens // HOT_PART)
    listed = tokens.join(F.broadcast(df.where(often).withColumnRenamed("df", "often")), "token", "left")
    joined = (listed.where("often is null").drop("often").join(df.where(~often), "token")
              .unionByName(listed.where("often is not null").withColumnRenamed("often", "df")))
    ranked = (joined.groupBy("ref", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order")))
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    keys = (ranked.select("ref", F.explode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("k"))
            .where("k.df > 1").select("ref", F.col("k.token").alias("token")))
    keys = written(keys, "keys")
    meet = keys.groupBy("token").agg(F.min("ref").alias("head"))
    clusters = components(keys.join(meet, "token").select("ref", "head"), "ref", "head")

    # Blocks: small clusters share a bucket, a large one is cut into parts; parts meet in pairs.
    size_of = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    n_clustered = size_of.agg(F.sum("size")).first()[0] or 0
    buckets = int(max(1, -(-n_clustered // block_sets)))
    parts = F.ceil(F.col("size") / block_sets).cast("int")
    placed = (clusters.join(size_of, "component")
              .select(F.col("node").alias("ref"), F.col("component").alias("cluster"), parts.alias("parts"),
                      F.when(parts > 1, -F.col("component") - 1)
                      .otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets))).alias("bucket"),
                      F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")))
    pairs = F.expr("transform(sequence(0, parts - 1), k -> named_struct('i', least(part, k), "
                   "'j', greatest(part, k), 'side', if(part = k, 2, if(part < k, 0, 1))))")
    spread = placed.withColumn("p", F.explode(pairs)).select("ref", "cluster", "bucket", "p.*")
    blocks = written(cut.join(spread, "ref"), "blocks")
    overlaps = blocks.groupBy("bucket", "i", "j", "frag").applyInPandas(
        lambda g: partial_overlaps(g, percent),
        "bucket long, i int, j int, ref long, n long, others binary, counts binary")
    members = blocks.where("side <> 0").select("bucket", "i", "j", "ref", "n").distinct()

    def total(counts: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        return summed_links(counts, of, percent)

    links = written(overlaps.groupBy("bucket", "i", "j").cogroup(members.groupBy("bucket", "i", "j"))
                    .applyInPandas(total, "a long, b long"), "links")
    groups = classes.join(components(links, "a", "b"), F.col("hi") == F.col("node"))
    least = groups.groupBy("component").agg(F.min("first").alias("least"))
    named = groups.join(least, "component").select("hi", "lo", "n", "least").unionByName(
        classes.join(groups.select("hi", "lo", "n"), ["hi", "lo", "n"], "left_anti")
        .select("hi", "lo", "n", F.col("first").alias("least")))
    return (sets.join(named, ["hi", "lo", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")))


def one_per_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their group (component), with its own columns.

    Of rows that repeat a kept doc_id one stays; rows with a null doc_id all stay.
    """
    mark = "kept"
    while mark in docs.columns:
        mark += "_"
    classes = (jaccard_classes(docs, width, percent).where("doc_id is not null").groupBy("doc_id")
               .agg(F.max(F.col("doc_id") == F.col("component_id")).alias(mark), F.count(F.lit(1)).alias("n")))
    marks = written(classes.where((F.col("n") > 1) | ~F.col(mark)).select("doc_id", mark), "marks")
    marked = docs.join(marks, "doc_id", "left").select(*docs.columns, mark)
    out = marked.where(F.col(mark).isNull())
    if not marks.where(mark).isEmpty():
        out = out.unionByName(marked.where(mark).dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)


JACCARD_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}),
         lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) END AS s
  FROM w
), g AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * shared >= {PERCENT} * (na + nb - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       (SELECT min(seen) FROM reach WHERE node = s.doc_id) AS component_id
FROM s
"""
