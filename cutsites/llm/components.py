"""Linking rows of a metric space: buckets of candidates to links, links to connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutsites.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node of its component.

    Each round gives every node its smallest neighbour as parent, follows two parents, and contracts the graph by it. Stars end
    in one round, chains shrink by at least a factor of four. A node with many edges only meets aggregates and joins.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("root"))
        parent = written(parent, "parents")
        grand = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jump = parent.join(grand, "root").select("node", F.col("up").alias("root"))
        parent = written(jump, "parents")
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            roots = written(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(a, "a").join(b, "b").where("ra <> rb")
        left = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: What one side of a task may hold: members, and the sum of their sizes (bytes).
MAX_MEMBERS, MAX_BYTES = 512, 1 << 21


def link_buckets(
    buckets: DataFrame, distances: Callable[[DataFrame], DataFrame], limit: float, inside: Callable[[DataFrame], DataFrame],
    max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Links ``a, b`` that connect all that pairs inside the buckets (``bucket, node, size``) would connect.

    ``distances`` measures pairs ``a, b`` as ``d`` in a metric and may add ``linked``; without it, pairs with d <= limit are linked. No linked
    pair may be further apart than ``limit``.

    First, every member of a bucket is measured against one leader. By the triangle inequality a linked member x and another one y
    can only be within the limit if d(y, leader) <= d(x, leader) + limit: members that are not linked and linked ones near
    the rim stay open, the leader and the rest are done. A bucket whose open members are all connected is done, so a group of copies ends here, however
    large it is.

    What is left, members of one bucket that are not connected, is cut into blocks within ``max_members`` and ``max_bytes``, and each two blocks
    of a bucket are a task. ``inside`` gets rows ``bucket, i, j, node, root, second`` and returns, for every (bucket, i, j), links that connect what
    pairs of nodes with different roots, of both sides or of one (i = j), would connect. No bucket is gathered in a task and no
    candidate pair is left out.
    """
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(buckets.join(heads, "bucket").where("node <> leader"), "members")
    measured = distances(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    if "linked" not in measured.columns:
        measured = measured.withColumn("linked", F.col("d") <= limit)
    measured = written(measured, "measured")
    links = measured.where("linked").select("a", "b")
    known = members.join(measured.select(F.col("a").alias("leader"), F.col("b").alias("node"), "d", "linked"), ["leader", "node"])
    rim = known.where(~F.col("linked")).groupBy("bucket").agg(F.min("d").alias("closest"))
    open_ = known.join(rim, "bucket").where(F.col("d") + F.lit(limit) >= F.col("closest")).select("bucket", "node", "size")
    rooted = open_.join(connected(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "open")
    # Open buckets, equal ones once.
    kinds = rooted.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes"),
        F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"),
    ).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("n") / max_members), F.ceil(F.col("bytes") / max_bytes)).cast("int")
    kinds = kinds.groupBy("n", "bytes", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks"))
    cut = rooted.join(kinds, "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(node, bucket), blocks) as int)"))
    tasks = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", (F.col("own") > F.col("other")).alias("second")
    )
    return links.unionByName(written(inside(tasks), "links"))
