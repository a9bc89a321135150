"""How filters of a corpus interact: what each removes, alone and in every order, with exact duplicates found by radix tries.

Five filters look at whole texts (null: empty; words are ``[^\\x20\\x09-\\x0D]+``). A document fails

* A: with under 200 words;
* B: if 100 times its distinct words are under 50 times its words;
* C: if 100 times its ``[A-Z]`` are over 2 times its code points;
* D: if it holds any of ``#$%&*|``;
* E: if a document with a smaller id has the same text, in any source.

A to D become a mask of bits next to each document. E comes from radix tries. Texts are cut into ranges by prefixes that adapt: a
prefix of 4 characters, and where the texts below it have over 8 MB and are not all one text, 32, 256 and so on; these counts cover all texts.
A range goes to one task. Each batch of rows first inserts its texts into a trie of its own, so a range gets one row a batch for each of its texts,
whatever the number of copies. The range's trie is compressed: an edge is a piece of text, a terminal holds the smallest id. A walk over it gives the
first document of each text; all other documents of the text fail E. The masks, with the labels, are then counted by source: 32 masks and four
label pairs a source, from which all orders follow.

Memory of a task: one batch, or the trie of one range (8 MB of texts counted with their copies, or one longer text). Tables of heavy prefixes are 64-bit
hashes, at most one for 8 MB of text, and broadcast only if few. Nothing is sent for pairs of copies.

Defined cases: a null id is not smaller or larger than any, so it never fails E and makes nothing fail. Rows that share the smallest id of
their text do not fail. A label counts for an id if any of its rows has it. A null source is the part ''. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import BYTE_CODES, LEADS, NOT_SPACE, Texts, chunks, totals, words_of
from cutsites.llm.common import per_text, ship, written
from cutsites.session import broadcast_if_small

FILTERS = "ABCDE"
RANGE_BYTES = 8 << 20
FIRST_PREFIX, LONGER = 4, 8

_b = np.arange(256)
UPPER = (_b >= 0x41) & (_b <= 0x5A)
SYMBOL = np.isin(_b, np.frombuffer(b"#$%&*|", np.uint8))


class Node:
    """Of a trie: the piece of text that leads here, children by their first byte, and the least value of the text that ends here."""

    __slots__ = ("children", "edge", "least")

    def __init__(self, edge: bytes, least: tuple[int, int] | None = None) -> None:
        self.edge, self.least, self.children = edge, least, {}


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


class RadixTrie:
    """Texts as a compressed trie; a terminal holds the least value given for its text: an id and what belongs to it."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, text: bytes, value: tuple[int, int]) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], value)
                return
            if not text.startswith(child.edge, at):
                same = common(child.edge, text[at : at + len(child.edge)])
                above = Node(child.edge[:same])
                child.edge = child.edge[same:]
                above.children[child.edge[0]] = child
                node.children[text[at]] = child = above
            node, at = child, at + len(child.edge)
        node.least = value if node.least is None else min(node.least, value)

    def walk(self) -> Iterator[tuple[int, int]]:
        """The values of all terminals."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.least is not None:
                yield node.least
            stack += node.children.values()


def failures(texts: Texts) -> np.ndarray:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text fails."""
    words = words_of(texts, NOT_SPACE, BYTE_CODES)
    order = np.lexsort((words.hash, words.text))
    new = np.ones(len(words), bool)
    if len(words):
        new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    n, distinct = words.counts, totals(new, words.first)
    upper, points, symbols = (texts.count(flags[texts.data]) for flags in (UPPER, LEADS, SYMBOL))
    found = [n < 200, 100 * distinct < 50 * n, 100 * upper > 2 * points, symbols > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(found))


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Per document: id, part, 64 bits of the text's hash, and the mask of A to D."""
    narrow = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", F.xxhash64("text"))
    return per_text(narrow, lambda texts: {"mask": failures(texts)}, [T.StructField("mask", T.IntegerType(), False)], ["id", "part", "key"])


def ranged(texts: DataFrame, quota: int = RANGE_BYTES) -> DataFrame:
    """Column ``prefix`` for rows of ``text`` and ``key``: the shortest of the adaptive prefixes whose range is light, or holds one text."""
    size, heavy, prefix = FIRST_PREFIX, texts, F.substring("text", 1, FIRST_PREFIX)
    while True:
        here = F.xxhash64(F.substring("text", 1, size))
        below = heavy.groupBy(here.alias("h")).agg(
            F.sum(F.octet_length("text")).alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b"), F.max(F.length("text")).alias("longest"),
        )
        known = written(below.where((F.col("bytes") > quota) & (F.col("a") != F.col("b")) & (F.col("longest") > size)).select("h"), "prefixes")
        if known.isEmpty():
            return texts.withColumn("prefix", prefix)
        flag = f"heavy{size}"
        known = broadcast_if_small(known.select(F.col("h").alias(f"h{size}"), F.lit(True).alias(flag)))
        texts = texts.join(known, here == F.col(f"h{size}"), "left").drop(f"h{size}")
        prefix = F.when(F.col(flag), F.substring("text", 1, size * LONGER)).otherwise(prefix)
        heavy, size = texts.where(flag), size * LONGER


def first_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", quota: int = RANGE_BYTES) -> DataFrame:
    """For each text that has an id: the smallest ``id``, and the ``key`` of the text (64 bits of hash)."""
    ship(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), whole.alias("text"), F.xxhash64(whole).alias("key")).where("id is not null")
    rows = ranged(rows, quota).select("prefix", "id", "key", "text")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text of a chunk once, with its smallest id."""
        for batch in batches:
            for part, _ in chunks(batch, "text", quota):
                trie = RadixTrie()
                for k, (number, one) in enumerate(zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    trie.insert(one.encode(), (number, k))
                yield part.take(pa.array(sorted(k for _, k in trie.walk()), pa.int64()))

    def inserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first document of each text; rows come range after range."""
        prefix, trie = None, RadixTrie()

        def firsts() -> pa.RecordBatch:
            found = list(trie.walk())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["id", "key"])

        for batch in batches:
            for own, number, key, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != prefix:
                    yield firsts()
                    prefix, trie = own, RadixTrie()
                trie.insert(one.encode(), (number, key))
        yield firsts()

    return rows.mapInArrow(combined, rows.schema).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(inserted, "id long, key long")


def failing(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", quota: int = RANGE_BYTES) -> DataFrame:
    """Per document: ``id``, ``part`` and ``mask``, whose bits 1, 2, 4, 8 and 16 are the filters A to E that it fails."""
    rows = masks(docs, text, doc_id, source)
    firsts = first_documents(docs, text, doc_id, quota).select(F.col("id").alias("first"), F.col("key").alias("first_key"))
    # Rows without an id go by their text, so that they do not meet in one place.
    own = F.coalesce("id", "key")
    flagged = rows.join(firsts, (own == F.col("first")) & (F.col("key") == F.col("first_key")) & F.col("id").isNotNull(), "left")
    return flagged.select("id", "part", "key", F.expr("mask + case when id is not null and first is null then 16 else 0 end").alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents by ``part`` and ``mask``: ``n``, and how many of them are ``good`` and ``toxic`` by their labels."""
    marks = labels.groupBy(F.col(f"`{doc_id}`").cast("long").alias("label_id")).agg(
        F.max(F.expr("cast(coalesce(quality = 1, false) as bigint)")).alias("good"), F.max(F.expr("cast(coalesce(toxic = 1, false) as bigint)")).alias("toxic"),
    )
    labelled = rows.join(marks, (F.coalesce("id", "key") == F.col("label_id")) & F.col("id").isNotNull(), "left")
    total = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), *total)


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from the counts by mask."""
    orders = ",".join(map("".join, permutations(FILTERS)))
    bit = "shiftleft(1, instr('ABCDE', substr(filter_order, {}, 1)) - 1)".format
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 masks at most
    rows = rows.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("own", F.expr(bit("step"))).withColumn(
        "before", F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (a, i) -> a + {bit('i')})")
    )

    def total(value: str, condition: str) -> F.Column:
        return F.expr(f"aggregate(m, 0L, (a, x) -> a + case when {condition} then {value} else 0L end)")

    here = "x.mask & own > 0 and x.mask & before = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("x.n", "x.mask & (before | own) = 0").alias("kept"),
        total("x.n", here).alias("removed"),
        total("x.n", "x.mask & own > 0 and x.mask & before > 0").alias("redundant"),
        total("x.n", "x.mask = own").alias("unique_fails"),
        total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"),
        # Of the documents that fail k filters, a filter removes those of 120 / k orders.
        total("x.n * (120 div bit_count(x.mask))", "x.mask & own > 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The table of ``interactions`` for documents and their labels (columns quality and toxic)."""
    return interactions(mask_counts(failing(docs, text, doc_id, source), labels, doc_id))
