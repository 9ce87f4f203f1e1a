"""Near-duplicate embeddings by an exact metric range join.

On unit vectors cosine >= c is Euclidean distance <= e = sqrt(2 - 2c). Pivots
partition the vectors into cells (each vector's home is its nearest pivot).
The triangle inequality sets which other cells need a copy of a vector, and
each cell then finds the links of its home vectors on its own: the cell holds
every vector within e of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealbook.llm.common import components, written

THRESHOLD = 0.95
#: Vectors of one side of a block pair: bounds a task's memory.
BLOCK = 8192
#: Pivots are broadcast to the tasks; beyond this many, cells grow and are cut into more blocks.
MAX_PIVOTS = 2048
#: Rounding room of single-precision products and of distances near a bound.
SLACK = 1e-4


@F.pandas_udf(T.BinaryType())
def normalised(vectors: pd.Series) -> pd.Series:
    """The raw doubles of valid vectors as bytes, null for the others."""
    raw = []
    for vec in vectors:
        x = np.empty(0) if vec is None else np.asarray(vec, dtype=np.float64) + 0.0  # -0.0 becomes 0.0
        raw.append(x.tobytes() if x.size and np.isfinite(x).all() and x.any() else None)
    return pd.Series(raw, dtype=object)


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _by_dim(pdf: pd.DataFrame, pivots: dict[int, np.ndarray]):
    for dim, part in pdf.groupby(pdf["vec"].str.len() // 8):
        yield int(dim), part, unit(part["vec"].tolist()), pivots[int(dim)]


def homes(batches: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dim, part, x, p in _by_dim(pdf, pivots):
            d = _distances(x, p)
            home = d.argmin(axis=1)
            yield part.assign(dim=dim, cell=home.astype(np.int32), far=d[np.arange(len(d)), home])


def replicas(batches: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray],
             cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], reach: float,
             blocks: int) -> Iterator[pd.DataFrame]:
    """Home rows for every candidate block, candidate rows for every home block of the cells they may touch."""
    for pdf in batches:
        for dim, part, x, p in _by_dim(pdf, pivots):
            near, far, home_blocks = cells[dim]
            d, own = _distances(x, p), part["cell"].to_numpy()
            room = reach + SLACK
            # y within reach of x and at home in cell j gives, by the triangle inequality,
            # d(x,pj) <= d(y,pj) + reach <= d(y,pi) + reach <= d(x,pi) + 2 reach, and |d(x,pj) - d(y,pj)| <= reach.
            touch = (d <= part["far"].to_numpy()[:, None] + 2 * room) & (d <= far + room) & (d >= near - room)
            touch[np.arange(len(part)), own] = True
            place = part["place"].to_numpy()
            rows, cell = np.nonzero(touch)
            copies = home_blocks[cell]
            rows, cell = np.repeat(rows, copies), np.repeat(cell, copies)
            h = np.arange(rows.size) - np.repeat(np.cumsum(copies) - copies, copies)
            cand = pd.DataFrame({"cell": cell, "hb": h, "cb": place[rows] % blocks, "home": False, "at": rows})
            at = np.repeat(np.arange(len(part)), blocks)
            home = pd.DataFrame({"cell": own[at], "hb": place[at] % home_blocks[own[at]],
                                 "cb": np.tile(np.arange(blocks), len(part)), "home": True, "at": at})
            for out in (home, cand):
                for first in range(0, len(out), 4 * BLOCK):
                    some = out.iloc[first: first + 4 * BLOCK]
                    src = part.iloc[some["at"].to_numpy()]
                    yield pd.DataFrame({"dim": dim, "cell": some["cell"].to_numpy(), "hb": some["hb"].to_numpy(),
                                        "cb": some["cb"].to_numpy(), "home": some["home"].to_numpy(),
                                        "rep": src["rep"].to_numpy(), "copies": src["copies"].to_numpy(),
                                        "vec": src["vec"].to_numpy()})


def linked(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the home vectors of one block pair: their weighted number, and a forest that spans them."""
    home, cand = rows[rows["home"]], rows[~rows["home"]]
    if home.empty or cand.empty:
        return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
    h, c = unit(home["vec"].tolist()), unit(cand["vec"].tolist())
    h_id, c_id, copies = home["rep"].to_numpy(), cand["rep"].to_numpy(), cand["copies"].to_numpy()
    h32, c32 = h.astype(np.float32), c.astype(np.float32).T.copy()
    ids, back = np.unique(np.concatenate((h_id, c_id)), return_inverse=True)
    label = np.arange(ids.size)
    links = np.zeros(len(h), dtype=np.int64)
    seen = np.zeros(ids.size, dtype=bool)
    for first in range(0, len(h), 512):
        cos = h32[first: first + 512] @ c32
        hit = cos >= threshold + SLACK
        # Near the threshold the double-precision product decides.
        i, j = np.nonzero((cos >= threshold - SLACK) & ~hit)
        if i.size:
            hit[i, j] = np.einsum("ij,ij->i", h[first + i], c[j]) >= threshold
        for row in np.flatnonzero(hit.any(axis=1)):
            at = np.flatnonzero(hit[row])
            at = at[c_id[at] != h_id[first + row]]
            if not at.size:
                continue
            links[first + row] = copies[at].sum()
            nodes = np.append(back[len(h) + at], back[first + row])
            seen[nodes] = True
            groups = np.unique(label[nodes])
            if groups.size > 1:
                label[np.isin(label, groups)] = groups[0]
    root = ids[label]
    edges = np.flatnonzero(seen & (root != ids))
    return pd.concat([pd.DataFrame({"rep": h_id, "links": links, "root": h_id})[links > 0],
                      pd.DataFrame({"rep": ids[edges], "links": 0, "root": root[edges]})])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK,
                    max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine in double precision reaches
    ``threshold``. Null, zero and empty vectors, those with null or non-finite
    components and those with a null id link with nothing; neither do vectors of different
    lengths. Equal vectors are joined as one row with a count, so copies cost
    no pairs, and link with each other. Rows that repeat an id are vectors of
    their own in n_links and one node in component_id; so one without a valid
    vector has no links and lies in the component of its id. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    rows = written(rows.select("vec_id", normalised(whole).alias("vec")), "vectors")
    valid = rows.where("vec_id is not null and vec is not null")
    reps = valid.groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # A number of its own names each distinct vector: two of one id are two.
    reps = written(reps.withColumns({"place": F.shiftrightunsigned(F.xxhash64("vec"), 1),
                                     "rep": F.monotonically_increasing_id()}), "distinct")
    reach = float(np.sqrt(2.0 - 2.0 * threshold))
    n_dims = reps.groupBy(F.length("vec").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pivots = {}
    sizes = {r["b"] // 8: r["n"] for r in n_dims.collect()}
    for dim, n in sizes.items():
        k = max(1, min(max_pivots, n // block))
        chosen = (reps.where(F.length("vec") == dim * 8).orderBy(F.xxhash64(F.lit(1), "place"), "vec")
                  .limit(k).select("vec").collect())
        pivots[dim] = unit([bytes(r["vec"]) for r in chosen])
    home = written(reps.drop("first_id").mapInPandas(lambda it: homes(it, pivots), (
        "vec binary, rep long, copies long, place long, dim int, cell int, far double")), "homes")
    cells = {d: (np.full(len(p), np.inf), np.full(len(p), -np.inf), np.zeros(len(p), np.int64))
             for d, p in pivots.items()}
    for r in home.groupBy("dim", "cell").agg(F.min("far").alias("near"), F.max("far").alias("far"),
                                             F.count(F.lit(1)).alias("n")).collect():
        for held, value in zip(cells[r["dim"]], (r["near"], r["far"], -(-r["n"] // block))):
            held[r["cell"]] = value
    blocks = max([1, *(-(-n // block) for n in sizes.values())])
    spread = home.mapInPandas(lambda it: replicas(it, pivots, cells, reach, blocks), (
        "dim int, cell int, hb int, cb int, home boolean, rep long, copies long, vec binary"))
    found = written(spread.groupBy("dim", "cell", "hb", "cb").applyInPandas(
        lambda g: linked(g, threshold), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    held = written(valid.join(reps.select("vec", "rep"), "vec").select("vec_id", "rep"), "ids")
    # Vectors of one id are one node of the components.
    several = (held.groupBy("vec_id").agg(F.min("rep").alias("root"), F.max("rep").alias("last"))
               .where("root < last").drop("last"))
    bridges = held.join(several, "vec_id").select("rep", "root").where("rep <> root")
    groups = components(found.select("rep", "root").unionByName(bridges), "rep", "root")
    per_rep = (reps.select("rep", "first_id", "copies").join(links, "rep", "left")
               .join(groups, F.col("rep") == F.col("node"), "left")
               .select("rep", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("label")))
    least = per_rep.groupBy("label").agg(F.min("first_id").alias("component"))
    own = (held.join(per_rep.join(least, "label").select("rep", "n_links", "component"), "rep")
           .select("vec_id", "n_links", "component"))
    rest = rows.where("vec_id is null or vec is null").select("vec_id")
    same = (own.join(rest.distinct(), "vec_id", "left_semi")
            .groupBy("vec_id").agg(F.min("component").alias("component")))
    rest = rest.join(same, "vec_id", "left").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    return own.unionByName(rest).select(
        "vec_id", F.col("n_links").cast("long"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings), v AS (
  SELECT r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM rows
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS r, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE r = e.r) AS n_links,
       (SELECT min(seen) FROM reach WHERE node = e.vec_id) AS component_id,
       (SELECT min(seen) FROM reach WHERE node = e.vec_id) = e.vec_id AS kept
FROM rows e
"""
