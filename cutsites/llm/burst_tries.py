"""Prefix tree of conversations, built as burst tries.

Every conversation is rebuilt: the first h turns of the conversation that begins its block of 20 ids, then its own turns after its first h
(h is the CRC-32 of the decimal id, modulo 4). A node of the tree is a distinct sequence of first turns; its members are the conversations that begin
with it.

1. A turn becomes an id (MD5 of its role and text) and its number of words; texts go no further. A conversation is one row of turn ids.
2. Equal conversations become one row: they are sorted by a hash of all turn ids and by number, and a sweep digests their numbers one
   after the other (SHA-256 has no other way), counts them and keeps the smallest.
3. All rows begin in one suffix container below the root. A container that is too large bursts: the turns that all its members share
   become one compressed head, and the members go to a container for each next turn id. Only the heads and the rows of too large containers
   take part in the next round; there are as many rounds as heads above each other.
4. Containers, now bounded, go to shards. Each is sorted and swept into nodes: turns that a sequence shares with the next one stay open, the
   others close and give their totals to the node above.
5. Totals of containers are added up for the heads above them, and heads are unfolded into one node for each of their turns.

Hot keys: many conversations that begin alike are a container that bursts; equal ones are one row. Their numbers pass through one task as a
stream (a digest is a chain), without being gathered. Sizes of too large containers are broadcast only if few. One conversation is one
row of 24 bytes a turn.

Defined cases: null roles and texts are empty; null turns come first; turns of equal number order by role and by the MD5 of the
text; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and have no part. An empty table has no node.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutsites.llm.common import ship, written
from cutsites.session import broadcast_if_small

BLOCK, HEADS = 20, 4
CONTAINER_BYTES = 1 << 18
ROOT = b"\0" * 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, an array of (id, words) in order."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    told = rows.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"), F.md5(text_).alias("text"),
        F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ordered = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "words"))).alias("t"))
    return ordered.select("conv_id", F.expr("transform(t, x -> struct(unhex(md5(concat(x.text, x.role))) as id, x.words as words))").alias("turns"))


def rebuilt(rows: DataFrame, block: int = BLOCK, heads: int = HEADS, **columns: str) -> DataFrame:
    """Conversations with the first turns of their block's first conversation in place of their own."""
    own = conversations(rows, **columns).withColumn("h", F.expr(f"cast(crc32(cast(conv_id as string)) % {heads} as int)")).withColumn("base", F.expr(f"conv_id - conv_id % {block}"))
    first = own.where("conv_id = base").select(F.col("base").alias("first_id"), F.slice("turns", 1, heads).alias("first"))
    # A block has one first conversation and ``block`` members at most.
    both = own.join(first, F.col("base") == F.col("first_id"), "left")
    return both.select("conv_id", F.expr("concat(slice(coalesce(first, array()), 1, h), slice(turns, h + 1, greatest(size(turns), 1)))").alias("turns"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Each sequence of turns once: smallest ``conv_id``, number ``n`` and digest ``ends`` of the conversations, ``ids`` and ``words``."""
    ship(convs.sparkSession)
    keyed = convs.select(
        F.expr("unhex(sha2(array_join(transform(turns, x -> hex(x.id)), ''), 256))").alias("key"), "conv_id",
        F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"),
    )

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []  # key, smallest conv_id, count, digest, ids, words

        def closed(row: list) -> tuple:
            return row[1], row[2], row[3].hexdigest(), row[4], row[5]

        def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string()), batch.schema.field("ids"), batch.schema.field("words")])
            done = []
            keys, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (key, number) in enumerate(zip(keys, numbers, strict=True)):
                if open_ and open_[0] == key:
                    open_[2] += 1
                    open_[3].update(f",{number}".encode())
                else:
                    if open_:
                        done.append(closed(open_))
                    open_ = [key, number, 1, hashlib.sha256(str(number).encode()), batch.column(2)[k].as_py(), batch.column(3)[k].as_py()]
            yield batch_of(done, schema)
        if open_:
            yield batch_of([closed(open_)], schema)

    ordered = keyed.repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.mapInArrow(swept, "conv_id long, n long, ends string, ids array<binary>, words array<long>")


def burst(sequences: DataFrame, container_bytes: int = CONTAINER_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Rows in containers, and the heads above them.

    Containers: the sequences with ``c`` (container), ``d`` (turns above it), ``parent`` (smallest member of the node above) and ``up`` (heads above).
    Heads: ``c``, ``up``, ``d``, ``parent``, ``conv_id``, ``n``, ``leaf`` (it is one long sequence), ``ends`` (at its last turn) and ``words`` (of its turns).
    """
    active = sequences.select("*", F.lit(ROOT).alias("c"), F.lit(0).alias("d"), F.lit(None).cast("long").alias("parent"), F.expr("cast(array() as array<binary>)").alias("up"))
    settled, heads = [], []
    while True:
        bytes_ = active.groupBy("c").agg(F.sum(F.expr("64 + 24 * (size(ids) - d)")).alias("bytes"))
        large = written(bytes_.where(F.col("bytes") > container_bytes).select("c"), "containers")
        if large.isEmpty():
            settled.append(active)
            break
        large = broadcast_if_small(large)
        settled.append(active.join(large, "c", "left_anti"))
        rest = "slice({}, d + 1, greatest(size(ids) - d, 1))".format
        inside = active.join(large, "c", "left_semi").select("*", F.expr(rest("ids")).alias("tail"))
        # What the first and the last suffix in order share, all of them share.
        tops = inside.groupBy("c", "up", "d", "parent").agg(
            F.min("conv_id").alias("top"), F.sum("n").alias("members"), F.min(F.struct("tail", "words")).alias("low"), F.max("tail").alias("high"),
        )
        differ = "filter(sequence(1, least(size(low.tail), size(high))), i -> element_at(low.tail, i) <> element_at(high, i))"
        size = "least(size(low.tail), size(high))"
        tops = tops.withColumn("shared", F.expr(f"case when {size} = 0 then 0 else coalesce(try_element_at({differ}, 1) - 1, {size}) end"))
        tops = written(tops.select("c", "up", "d", "parent", "top", "members", "shared", F.expr("low.tail = high").alias("leaf"), F.expr("slice(low.words, greatest(d, 1), shared + if(d = 0, 0, 1))").alias("path")), "heads")
        found = broadcast_if_small(tops.select("c", "top", "shared"))
        moved = inside.drop("tail").join(found, "c")
        ended = moved.where("size(ids) = d + shared").select(F.col("c").alias("ended"), "ends")
        heads.append(
            tops.join(ended, F.col("c") == F.col("ended"), "left")
            .select("c", "up", "d", "parent", F.col("top").alias("conv_id"), F.col("members").alias("n"), "leaf", "ends", F.when(F.col("d") == 0, F.concat(F.array(F.lit(0).cast("long")), "path")).otherwise(F.col("path")).alias("words"))
        )
        nearer = moved.where("size(ids) > d + shared").select(
            *sequences.columns, F.expr("unhex(md5(concat(c, element_at(ids, d + shared + 1))))").alias("c"), F.expr("d + shared + 1").alias("d"),
            F.col("top").alias("parent"), F.array_append("up", F.col("c")).alias("up"),
        )
        active = written(nearer, "burst")
    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    for more in heads[1:]:
        heads[0] = heads[0].unionByName(more)
    return containers, heads[0] if heads else None


def sweep(rows: list[tuple], d: int, parent: int | None) -> list[tuple]:
    """Nodes of one container from its suffixes: rows of (suffix ids, words of the turns from the d-th on, conv_id, n, ends).

    The first node is the container's top, at depth ``d``; ``words`` begin with the top's turn (0 for the root).
    """
    rows.sort(key=lambda r: r[0])
    nodes: list[list] = []  # conv_id, depth, node above, members, children, leaves, saved, ends, words

    def opened(depth: int, words: int, above: int | None) -> int:
        nodes.append([None, depth, above, 0, 0, 0, 0, NO_ENDS, words])
        return len(nodes) - 1

    path: list[int] = []

    def close() -> None:
        node = nodes[path.pop()]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[8]
        if path:
            above = nodes[path[-1]]
            above[3] += node[3]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
            above[0] = node[0] if above[0] is None else min(above[0], node[0])

    before: tuple | list = ()
    for ids, words, conv, n, ends in rows:
        if not path:
            path.append(opened(d, words[0], None))
        shared = 0
        for a, b in zip(before, ids):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            close()
        for k in range(shared, len(ids)):
            path.append(opened(d + k + 1, words[k + 1], path[-1]))
        last = nodes[path[-1]]  # sequences are distinct: one at most ends at a node
        last[0] = conv if last[0] is None else min(last[0], conv)
        last[3] += n
        last[7] = ends
        before = ids
    while path:
        close()
    return [(n[0], n[1], parent if n[2] is None else nodes[n[2]][0], *n[3:8]) for n in nodes]


def nodes(rows: DataFrame, container_bytes: int = CONTAINER_BYTES, **columns: str) -> DataFrame:
    """One row per node of the prefix tree of rebuilt conversations (schema ``NODE``)."""
    sequences = written(distinct_sequences(rebuilt(rows, **columns)), "sequences")
    containers, heads = burst(sequences, container_bytes)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Containers come one after the other; each is gathered, sorted and swept."""
        held, key = [], None

        def done() -> pa.RecordBatch:
            made = sweep([r[:5] for r in held], held[0][5], held[0][6])
            up = held[0][7]
            columns_ = [pa.array([n[i] for n in made], pa.string() if i == 7 else pa.int64()) for i in range(8)]
            tops = pa.array([up] + [None] * (len(made) - 1), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([*columns_, tops], names=[*[f.split()[0] for f in NODE.split(", ")], "up"])

        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key is not None and c != key:
                    yield done()
                    held = []
                key = c
                held.append(row)
        if held:
            yield done()

    suffixes = containers.select(
        "c", F.expr("slice(ids, d + 1, greatest(size(ids) - d, 1))").alias("ids"),
        F.expr("if(d = 0, concat(array(0L), words), slice(words, d, size(words) - d + 1))").alias("words"), "conv_id", "n", "ends", F.col("d").cast("long").alias("d"), "parent", "up",
    )
    found = suffixes.repartition("c").sortWithinPartitions("c").mapInArrow(swept, NODE + ", up array<binary>")
    if heads is None:
        return found.drop("up")
    found, heads = written(found, "nodes"), written(heads, "heads")
    # Totals below each head: tops of containers, and the turns of heads that are not its own.
    tops = found.where("up is not null").select("up", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    chains = heads.select("up", F.col("leaf").cast("long").alias("leaves"), F.expr("(n - 1) * aggregate(words, 0L, (a, x) -> a + x)").alias("saved"))
    below = tops.unionByName(chains).where("size(up) > 0").select(F.posexplode("up").alias("at", "head"), F.size("up").alias("all"), "leaves", "saved")
    below = below.groupBy("head").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum(F.expr("cast(at = all - 1 as bigint)")).alias("children")
    )
    joined = heads.join(below, F.col("c") == F.col("head"), "left").select(
        "c", "d", "parent", "conv_id", "n", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
        F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"), F.size("words").alias("long"), F.posexplode("words").alias("at", "turn_words"),
    )
    downward = Window.partitionBy("c").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("at") == F.col("long") - 1
    unfolded = joined.select(
        "conv_id", (F.col("d") + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        (F.col("saved") + F.sum(F.expr("(n - 1) * turn_words")).over(downward)).cast("long").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    return found.drop("up").unionByName(unfolded)
