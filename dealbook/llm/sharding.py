"""Uniform shuffle into exactly sized shards by a hypergeometric communication matrix.

Rows first lie in input blocks. The matrix entry (block, shard) says how many
rows of the block go to the shard; it is drawn from the multivariate
hypergeometric law that a uniform permutation of all rows would give, so shard
sizes are exact and every assignment is equally likely. Each block permutes its
rows locally and cuts them by its matrix row, the rows move, and each shard
permutes what it received.

All of it is DataFrame expressions. Random numbers are hashes of (seed, place),
so a retried task draws the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealbook.llm.common import written

LAW = "rows"
SHARDS = 40
#: Rows in one input block and in one slot range of a shard: what one task sorts at a time.
BLOCK_ROWS = 8192
#: A draw walks this many standard deviations around the mean; beyond them lies
#: less than 1e-30 of the law, far below the 2^-53 grain of a uniform double.
SIGMAS = 12


def uniform_sql(*key: str) -> str:
    """SQL for a double in (0, 1) from a hash of its key."""
    return f"((cast(shiftrightunsigned(xxhash64({', '.join(key)}), 11) as double) + 0.5) * {2.0 ** -53!r}D)"


def once_sql(value: str, name: str, use: str) -> str:
    """SQL for ``use``, an expression of ``name``, with ``value`` computed a single time."""
    return f"transform(array({value}), {name} -> {use})[0]"


def hypergeometric_sql(good: str, total: str, draws: str, u: str) -> str:
    """SQL for one draw: how many of ``good`` marked items are among ``draws`` of ``total``.

    Inverse transform: the walk starts at the mode with weight 1 and the ratio
    of neighbouring probabilities gives the other weights, so no factorial is
    needed. ``goal`` is u times the sum of weights; the draw is the first count
    whose running sum reaches it.
    """
    ratio = "(cast(s.g - k as double) * (s.n - k) / (cast(k + 1 as double) * (s.t - s.g - s.n + k + 1)))"

    def walk(first: str, last: str) -> str:
        return f"if({first} <= {last}, sequence({first}, {last}), cast(array() as array<bigint>))"

    def fold(steps: str, ratio: str) -> str:
        return (f"aggregate({steps}, named_struct('w', 1D, 's', 0D), "
                f"(acc, k) -> named_struct('w', acc.w * {ratio}, 's', acc.s + acc.w * {ratio}))")

    bounds = f"named_struct('g', {good}, 't', {total}, 'n', {draws}, 'u', {u})"
    limits = ("named_struct('g', b.g, 't', b.t, 'n', b.n, 'u', b.u, 'lo', greatest(0L, b.n + b.g - b.t), "
              "'hi', least(b.g, b.n), 'mode', cast(floor((cast(b.n as double) + 1) * (b.g + 1) / (b.t + 2)) as bigint), "
              f"'reach', cast(ceil({SIGMAS} * sqrt(cast(b.n as double) * b.g / greatest(b.t, 1L) "
              "* greatest(0D, 1 - cast(b.g as double) / greatest(b.t, 1L)))) as bigint) + 12)")
    mode = "least(greatest(c.mode, c.lo), c.hi)"
    span = (f"named_struct('g', c.g, 't', c.t, 'n', c.n, 'u', c.u, 'mode', {mode}, "
            f"'lo', greatest(c.lo, {mode} - c.reach), 'hi', least(c.hi, {mode} + c.reach))")
    below = fold(f"reverse({walk('s.lo', 's.mode - 1')})", f"(1 / {ratio})")
    above = fold(walk("s.mode", "s.hi - 1"), ratio)
    sums = once_sql(below, "d", f"named_struct('s', s, 'w', d.w, 'goal', (d.s + 1 + {above}.s) * s.u)")
    step = (f"named_struct('w', acc.w * {ratio.replace('s.', 'z.s.')}, "
            f"'s', if(acc.s < z.goal, acc.s + acc.w * {ratio.replace('s.', 'z.s.')}, acc.s), "
            "'k', if(acc.s < z.goal, k + 1, acc.k))")
    find = (f"aggregate({walk('z.s.lo', 'z.s.hi - 1')}, named_struct('w', z.w, 's', z.w, 'k', z.s.lo), "
            f"(acc, k) -> {step}).k")
    return once_sql(once_sql(once_sql(once_sql(bounds, "b", limits), "c", span), "s", sums), "z", find)


def split_row_sql(counts: str, draws: str, key: str, seed: int) -> str:
    """SQL that draws ``draws`` items without replacement from classes of the given sizes."""
    draw = hypergeometric_sql("x", "a.total", "a.rest", uniform_sql(f"{seed}", key, "size(a.out)"))
    put = "named_struct('total', a.total - x, 'rest', a.rest - m, 'out', concat(a.out, array(m)))"
    start = (f"named_struct('total', aggregate({counts}, 0L, (p, q) -> p + q), 'rest', {draws}, "
             "'out', cast(array() as array<bigint>))")
    return f"aggregate({counts}, {start}, (a, x) -> {once_sql(draw, 'm', put)}).out"


def communication_matrix(block_rows: DataFrame, blocks: int, shards: int, rows: int, seed: int) -> DataFrame:
    """(block, counts) with the exact number of rows that each block sends to each shard.

    A tree over the blocks: the root holds all shard sizes; each node draws how
    many of its items fall to its left half and gives the rest to the right.
    Nodes of one level are independent rows, so a level is one parallel step.
    """
    spark = block_rows.sparkSession
    levels = max(0, (blocks - 1).bit_length())
    sizes = [rows // shards + (1 if j < rows % shards else 0) for j in range(shards)]
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"),
                                  F.array(*[F.lit(s).cast("long") for s in sizes]).alias("counts"))
    for level in range(levels):
        span = 1 << (levels - level - 1)
        left_rows = (block_rows.where(F.floor(F.col("block") / span) % 2 == 0)
                     .groupBy(F.floor(F.col("block") / (2 * span)).alias("node"))
                     .agg(F.sum("n").alias("left_rows")))
        drawn = split_row_sql("counts", "left_rows", f"node * 64 + {level}", seed)
        halves = once_sql(drawn, "l", "array(named_struct('node', node * 2, 'counts', l), named_struct("
                          "'node', node * 2 + 1, 'counts', zip_with(counts, l, (p, q) -> p - q)))")
        nodes = (nodes.join(left_rows, "node", "left").fillna(0, ["left_rows"])
                 .select(F.explode(F.expr(halves)).alias("x")).select("x.*"))
        if level % 6 == 5:
            nodes = written(nodes, "matrix")  # cuts the plan of a deep tree
    return written(nodes.withColumnRenamed("node", "block"), "matrix")


def placed(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """The rows of ``docs`` by their numbers: doc_id, size, text_crc32, place (64 random bits) and block."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    # The place hashes a number of the row too, so equal rows go to blocks of their own.
    base = base.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32",
                                               F.monotonically_increasing_id()))
    # Texts are read once, and places are fixed; everything after works on these few numbers.
    return written(base.withColumn("block", F.pmod("place", F.lit(blocks))), "places")


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` shards, law ``rows``.

    Shard sizes differ by at most one row; within them all assignments are
    equally likely, and ``slot`` is a uniform order in the shard, gapless from
    0. ``size`` is the UTF-8 bytes of the text plus 16; a null text has no
    bytes and the CRC of an empty one. Rows that repeat, share an id or have a
    null id are rows of their own; equal rows may change places. An empty table
    gives an empty result. Other columns of ``docs`` are not read. Copies
    of a text carry no group key here: the law counts rows alone.
    """
    rows = docs.count()
    blocks = max(1, -(-rows // block_rows))
    base = placed(docs, blocks, seed)
    block_rows_df = base.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(block_rows_df, blocks, shards, rows, seed).select(
        "block", F.transform("counts", lambda _, i: F.aggregate(
            F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    # Local permutation of each block, cut by its matrix row.
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "place"), "doc_id", "text_crc32")
    sent = (base.withColumn("at", F.row_number().over(local).cast("long"))
            .join(matrix, "block")
            .select("doc_id", "size", "text_crc32",
                    F.size(F.filter("ends", lambda e: e < F.col("at"))).alias("shard"),
                    F.xxhash64(F.lit(seed + 2), "place").alias("order")))
    # Permutation inside each shard, over ranges of the random order so that no task holds a shard.
    ranges = max(1, -(-rows // (shards * block_rows)))
    sent = sent.withColumn("range", F.floor(
        F.shiftrightunsigned("order", 11).cast("double") * F.lit(2.0 ** -53) * ranges).cast("long"))
    before = (sent.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.partitionBy("shard").orderBy("range")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
              .select("shard", "range", "before"))
    inner = Window.partitionBy("shard", "range").orderBy("order", "doc_id", "text_crc32")
    return (sent.withColumn("at", F.row_number().over(inner) - 1)
            .join(before, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"),
                    (F.col("before") + F.col("at")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
