"""Exact uniform shuffle into shards by a hypergeometric communication matrix.

Rows are dealt into blocks by a hash. From the block sizes the driver draws how many rows of each block go to each
shard: a table with fixed row sums (blocks) and column sums (shards, at most one row apart), drawn with the
probability that a uniform shuffle would give it. Each block is permuted and cut by its row of the table, the pieces are exchanged, and each
shard is permuted again. Permutations are orders of keyed hashes, so a lost task gives the same rows again.

Blocks and groups are about ``BLOCK_ROWS`` rows (at least ``BLOCKS`` and ``GROUPS`` of them): their number grows with the input, not their size. Only
their sizes reach the driver or are broadcast (a number for each block and shard, and for each shard and group), and no task
holds a shard: the second permutation sorts (shard, hash group) pieces whose offsets are prefix sums.

Null and empty texts count as one byte. Null ids and repeated rows are dealt like others; rows equal in id and
text are interchangeable and share a block. Fewer rows than shards leave some shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.session import local_table

BLOCKS = 256
GROUPS = 256
BLOCK_ROWS = 1 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows out of good + bad are good; exact at any size.

    Two binomials with one probability, given their sum, have this law. Where the sum is off, the difference
    (about its square root) is drawn back or added by the same law, down to a few single draws.
    """
    if drawn > (good + bad) // 2:
        return good - hypergeometric(rng, good, bad, good + bad - drawn)
    if drawn <= 32:
        took = 0
        for _ in range(drawn):
            hit = int(rng.integers(good + bad)) < good
            took, good, bad = took + hit, good - hit, bad - (not hit)
        return took
    p = drawn / (good + bad)
    g, b = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    if g + b >= drawn:
        return g - hypergeometric(rng, g, b, g + b - drawn)
    return g + hypergeometric(rng, good - g, bad - b, drawn - g - b)


def communication_matrix(rows: list[int], columns: list[int], seed: int = 0) -> np.ndarray:
    """A random table with these row and column sums."""
    rng = np.random.default_rng(seed)
    left = list(columns)
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, need in enumerate(rows):
        rest = sum(left)
        for j, room in enumerate(left):
            rest -= room
            took = hypergeometric(rng, room, rest, need)
            out[i, j], left[j], need = took, room - took, need - took
    return out


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 0, blocks: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows with ``shard`` and ``slot`` (gapless from 0 in each shard); these replace columns of the same names."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.count()
    blocks = blocks or max(BLOCKS, rows // BLOCK_ROWS)
    groups = max(GROUPS, rows // n_shards // BLOCK_ROWS)
    content = f"cast(`{doc_id}` as string), md5(coalesce(`{text}`, ''))"
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.expr(f"md5(concat_ws(':', '{seed}', 'first', {content}))").alias("__h1"),
        F.expr(f"md5(concat_ws(':', '{seed}', 'second', {content}))").alias("__h2"),
    )
    keyed = keyed.withColumn("__block", F.expr(f"cast(conv(substring(__h1, 1, 8), 16, 10) as bigint) * {blocks} div 4294967296L"))
    sizes = {r["__block"]: r["count"] for r in keyed.groupBy("__block").count().collect()}  # at most ``blocks`` rows
    order = sorted(sizes)
    total = sum(sizes.values())
    columns = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    bounds = np.cumsum(communication_matrix([sizes[b] for b in order], columns, seed), axis=1)
    schema = T.StructType([T.StructField("__block", T.LongType()), T.StructField("__bounds", T.ArrayType(T.LongType()))])
    matrix = local_table(docs.sparkSession, [(b, bounds[i].tolist()) for i, b in enumerate(order)], schema)
    within = Window.partitionBy("__block").orderBy("__h1")
    dealt = (
        keyed.withColumn("__at", F.row_number().over(within) - 1).join(F.broadcast(matrix), "__block")
        .withColumn("shard", F.expr("size(filter(__bounds, b -> b <= __at))"))
        .withColumn("__group", F.expr(f"cast(conv(substring(__h2, 1, 8), 16, 10) as bigint) * {groups} div 4294967296L"))
    )
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__group").count().select(
        "shard", "__group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")
    )
    again = Window.partitionBy("shard", "__group").orderBy("__h2")
    # A row for each shard and group: the bound of this broadcast.
    placed = dealt.withColumn("__in", F.row_number().over(again)).join(F.broadcast(offsets), ["shard", "__group"])
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", F.expr("__offset + __in - 1").alias("slot"))
