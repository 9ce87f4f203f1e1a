"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Rows are cut into query blocks and
candidate blocks; every pair of blocks is one task's unit of work. There the
candidates lie as postings by term (component), and each term of the query
rows scatters its weighted postings into dense score arrays. A partition
selection keeps the k best of the block, and a second one merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealbook.llm.common import written

SCALE = 64
K = 20
QUERY_EVERY = 20
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Query rows that accumulate together: their score arrays stay in the cache.
QUERY_ROWS = 32
_LONG = 2 ** 63


def quantise(batches: Iterator[pd.DataFrame], scale: int) -> Iterator[pd.DataFrame]:
    """Sparse rows: terms (uint32) and components (float64) whose floor after scaling is not zero."""
    for pdf in batches:
        ids, terms, weights = [], [], []
        for vec_id, vec in zip(pdf["vec_id"], pdf["embedding"]):
            if vec is None or pd.isna(vec_id):
                continue
            x = np.asarray(vec, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                at = np.flatnonzero(np.floor(x * scale))
            ids.append(int(vec_id))
            terms.append(at.astype(np.uint32).tobytes())
            weights.append(x[at].tobytes())
        yield pd.DataFrame({"vec_id": np.array(ids, dtype=np.int64), "terms": terms, "weights": weights})


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers if all are below 2^62, else Python's, exact at any size."""
    with np.errstate(over="ignore"):
        w = np.floor(x * scale)
    if not w.size or np.abs(w).max() < 2.0 ** 62:
        return w.astype(np.int64)
    # From 2^53 on a double is an integer itself.
    return np.array([int(v) if abs(u) < 2.0 ** 53 else int(u) * scale for u, v in zip(x.tolist(), w.tolist())],
                    dtype=object)


def _csr(terms: list[bytes], weights: list[bytes], scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(t) // 4 for t in terms], dtype=np.int64)
    rows = np.repeat(np.arange(len(terms)), lens)
    return (rows, np.frombuffer(b"".join(terms), np.uint32),
            _integers(np.frombuffer(b"".join(weights), np.float64), scale))


def block_top_k(queries: pd.DataFrame, cands: pd.DataFrame, k: int, scale: int = SCALE) -> pd.DataFrame:
    """The k best candidates of one block for each query of one block."""
    cands = cands.sort_values("vec_id", kind="stable")
    queries = queries.sort_values("vec_id", kind="stable")
    cand_ids, query_ids = cands["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    n = cand_ids.size
    rows, terms, weights = _csr(cands["terms"].tolist(), cands["weights"].tolist(), scale)
    order = np.argsort(terms, kind="stable")  # postings by term, candidates ascending
    rows, weights = rows[order], weights[order]
    bounds = np.flatnonzero(np.diff(terms[order], prepend=-1, append=-1))
    postings = {int(terms[order[a]]): (a, b) for a, b in zip(bounds[:-1], bounds[1:])} if terms.size else {}
    q_rows, q_terms, q_weights = _csr(queries["terms"].tolist(), queries["weights"].tolist(), scale)
    query_rows = queries["row"].to_numpy()
    top_c, top_q = (int(np.abs(x).max()) if x.size else 0 for x in (weights, q_weights))
    most = top_c * top_q * max(1, min(len(postings), int(np.bincount(q_rows).max()) if q_rows.size else 1))
    # The narrowest type that holds every partial sum and the sort key below.
    kind = np.int32 if most < 2 ** 31 else np.int64 if most * max(n, 1) < 2 ** 62 else object
    weights = weights.astype(kind)
    out_q, out_r, out_v, out_s = [], [], [], []
    q_starts = np.searchsorted(q_rows, np.arange(len(queries) + 1))
    for first in range(0, len(queries), QUERY_ROWS):
        last = min(first + QUERY_ROWS, len(queries))
        a, b = q_starts[first], q_starts[last]
        part = {}
        for t, row, w in zip(q_terms[a:b].tolist(), (q_rows[a:b] - first).tolist(), q_weights[a:b].tolist()):
            part.setdefault(t, []).append((row, w))
        scores = np.zeros((n, last - first), dtype=kind)
        for t, entries in part.items():
            if t not in postings:
                continue
            p, q = postings[t]
            row = np.zeros(last - first, dtype=kind)
            for i, w in entries:
                row[i] = w
            weighted = weights[p:q, None] * row[None, :]
            if q - p == n:
                scores += weighted
            else:
                scores[rows[p:q]] += weighted
        for i in range(last - first):
            me = int(query_ids[first + i])
            score = scores[:, i]
            if kind is object:  # scores past 64 bits are held at the limit, and so tie
                score = np.array([max(-_LONG, min(_LONG - 1, int(x))) for x in score], dtype=object)
            # One key orders by score, then by smaller vec_id (candidates are ascending).
            key = score.astype(object if kind is object else np.int64) * n + np.arange(n - 1, -1, -1)
            ids = np.flatnonzero(cand_ids != me)
            if ids.size > k:
                ids = ids[np.argpartition(key[ids], ids.size - k)[-k:]] if kind is not object \
                    else np.array(sorted(ids.tolist(), key=lambda j: key[j])[-k:])
            out_q += [me] * ids.size
            out_r += [int(query_rows[first + i])] * ids.size
            out_v += cand_ids[ids].tolist()
            out_s += [int(x) for x in score[ids]]
    return pd.DataFrame({"query_id": out_q, "row": out_r, "vec_id": out_v, "score": out_s}).astype("int64")


def top_k_search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE,
                 candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id ``every`` divides; candidates are all
    rows but those of the query's own id. Rows with a null id, a null vector or
    null or non-finite components take no part; an empty vector scores 0 with
    all. Vectors may differ in length: missing components count as 0. Every row
    is a candidate, equal ones too, and every query row a query with a list of
    its own. Components of any finite size are exact; scores beyond 64 bits are
    held at the limit, where they tie. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
            .where("not exists(embedding, x -> x is null)")
            .mapInPandas(lambda it: quantise(it, scale), "vec_id long, terms binary, weights binary"))
    # The number deals rows out, so that equal ones do not meet in one block.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sparse")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))
    place = F.xxhash64("row")

    def dealt(df, own, blocks, other, copies):
        return (df.withColumn(own, F.pmod(place, F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))

    queries = dealt(rows.where(F.col("vec_id") % every == 0), "qb", q_blocks, "cb", c_blocks)
    cands = dealt(rows, "cb", c_blocks, "qb", q_blocks)

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return block_top_k(left, right, k, scale)

    best = (queries.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb"))
            .applyInPandas(join, "query_id long, row long, vec_id long, score long"))
    merge = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


TOP_K_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w),
         lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
