"""Benchmark decontamination with an FM-index over every shard of the training texts.

A shard is a chunk of an Arrow batch (about 0.5 MB of text). Its words are numbered by the vocabulary of
the test phrases; runs of such words that are long enough to hold a phrase are indexed, all others cannot
hold one. The index is the Burrows-Wheeler transform of the runs, kept as a wavelet tree (one bit row with
running counts for each bit of a symbol), and every eighth suffix position. All phrases are searched
backward at once; their occurrences are located by stepping back to a sampled position, and overlapping or touching
ones of a text merge into removal spans.

Test phrases are a query set: they are read in blocks of at most ``BLOCK_WORDS`` words, and every block is searched in every shard.
``AT_ONCE`` blocks are sent at a time; a larger benchmark takes more passes over the documents, each of which adds its hits to the rows and gives
its blocks up before the next ones are read. So neither the driver nor a task holds more than ``AT_ONCE`` blocks.

A phrase is a window of ``WINDOW`` words of an item; an item of fewer words, but not none, is one phrase. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and empty texts have no words and no spans; empty or
null items give no phrase; an item without id counts as one with the id ``null``; repeated items count once. Repeated
documents are handled row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutsites.llm.arrays import ALNUM, FOLDED_CODES, Texts, Words, chunks, covered, texts_of, totals, words_of
from cutsites.llm.common import TEXT, ship, written

WINDOW = 10
BLOCK_WORDS, AT_ONCE = 200_000, 8
SAMPLE = 8


class WaveletTree:
    """Ranks of symbols in a sequence; level k holds bit k (highest first) of the symbols in the order of the level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        values, at = np.unique(symbols, return_index=True)  # equal symbols lie together now
        self.first = np.zeros(1 << bits, np.int64)
        self.first[values] = at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        at = at.copy()
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = self.ones[k][at]
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - self.first[symbol]


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``keys`` ends with a value that occurs once and is the smallest."""
    n = len(keys)
    _, rank = np.unique(keys, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1 if step < n else 0
        joined = rank * (n + 1) + later
        order = np.argsort(joined, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(joined[order[1:]] != joined[order[:-1]])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search over runs of symbols (1 and up) that are joined by separators (0)."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        n = len(symbols)
        separators = np.flatnonzero(symbols == 0)
        keys = symbols + len(separators)
        keys[separators] = np.arange(len(separators))[::-1]  # distinct, the last one smallest
        order = suffix_order(keys)
        before = symbols[order - 1]
        self.size = n
        self.tree = WaveletTree(before, bits)
        counts = np.bincount(symbols, minlength=(1 << bits) + 1)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.before = before
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[separators[:-1] + 1] = True  # stepping back never crosses a separator
        self.sampled = (order % SAMPLE == 0) | starts[order]
        self.position = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with each row of ``patterns``."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.less[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at ``rows``, by steps back to a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            at = rows[live]
            symbol = self.before[at]
            rows[live] = self.less[symbol] + self.tree.rank(symbol, at)
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.position[rows] + steps


@dataclass
class Phrases:
    """A block of the query set: per length, the distinct phrases as word numbers and the items that hold them."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, list[list[int]]]]
    names: list[str]

    @property
    def shortest(self) -> int:
        return min(self.by_length)


def phrase_block(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """Phrases of some items (id, text); None if there are none."""
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    words = words_of(_joined([text for _, text in items]), ALNUM, FOLDED_CODES)
    if not len(words):
        return None
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    found: dict[int, dict[tuple, set[int]]] = {}
    for i, (name, _) in enumerate(items):
        own = tuple(symbol[words.first[i] : words.first[i + 1]].tolist())
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            found.setdefault(n, {}).setdefault(own[k : k + n], set()).add(number[name])
    by_length = {n: (np.array(list(p), np.int64).reshape(len(p), n), [sorted(x) for x in p.values()]) for n, p in found.items()}
    return Phrases(vocabulary, by_length, names)


def _joined(texts: list[str]) -> Texts:
    raw = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def find(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the words of a shard: first word, end word; and pairs (text, item number)."""
    none = np.zeros(0, np.int64)
    at = np.searchsorted(phrases.vocabulary, words.hash)
    at[at == len(phrases.vocabulary)] = 0
    symbol = np.where(phrases.vocabulary[at] == words.hash, at + 1, 0)
    text = words.text
    # Runs of phrase words inside a text, and those that are long enough.
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] == 0) | (symbol[:-1] == 0) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(symbol)))
    good = (symbol[begin] > 0) & (length >= phrases.shortest) if len(begin) else np.zeros(0, bool)
    begin, length = begin[good], length[good]
    if not len(begin):
        return none, none, none, none
    # The runs, each followed by a separator; where[i] is the word at position i.
    total = int((length + 1).sum())
    offset = np.concatenate([[0], np.cumsum(length + 1)])
    where = np.repeat(begin - offset[:-1], length + 1) + np.arange(total)
    is_separator = np.zeros(total, bool)
    is_separator[offset[1:] - 1] = True
    symbols = np.where(is_separator, 0, symbol[np.minimum(where, len(symbol) - 1)])
    index = FMIndex(symbols, max(1, int(len(phrases.vocabulary)).bit_length()))
    starts, ends, hit_text, hit_item = [], [], [], []
    for n, (patterns, items) in phrases.by_length.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        many = high[hit] - low[hit]
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        place = where[index.locate(rows)]
        starts.append(place)
        ends.append(place + n)
        pattern = np.repeat(hit, many)
        pair = np.unique(np.stack([text[place], pattern]), axis=1)
        for t, p in pair.T.tolist():
            hit_text += [t] * len(items[p])
            hit_item += items[p]
    if not starts:
        return none, none, none, none
    return np.concatenate(starts), np.concatenate(ends), np.array(hit_text, np.int64), np.array(hit_item, np.int64)


def blocks(benchmark: DataFrame, id_column: str, text: str, limit: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The query set in blocks, streamed through the driver one at a time; a block holds at most ``limit`` words or one item."""
    held, words = [], 0
    rows = benchmark.selectExpr(f"coalesce(cast(`{id_column}` as string), 'null') as i", f"`{text}` as t").where("t is not null").distinct()
    for row in rows.toLocalIterator(prefetchPartitions=True):
        n = len(row.t) // 2 + 1
        if held and words + n > limit:
            yield from filter(None, [phrase_block(held)])
            held, words = [], 0
        held.append((row.i, row.t))
        words += n
    yield from filter(None, [phrase_block(held)] if held else [])


SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
    T.StructField("spans", T.ArrayType(SPAN, False), False),
]
CLEANED = T.StructField("cleaned", T.StringType(), True)
#: What a pass adds to rows: starts and ends of hit words, in turn, and names of items.
HITS = [T.StructField("__hits", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, cleaned: bool = True,
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``items`` (sorted ids), ``spans`` (byte ranges of the text to remove, merged, in
    order) and, if asked for, ``cleaned``: the text without its spans, each replaced by one space. These replace columns of the same
    names; other columns pass through."""
    spark = docs.sparkSession
    ship(spark)
    fields = [*FIELDS, CLEANED] if cleaned else FIELDS
    new = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(TEXT))
    source = blocks(benchmark, item_id, item_text)
    group = list(islice(source, AT_ONCE))
    while more := list(islice(source, 1)):  # not the last blocks
        sent = spark.sparkContext.broadcast(group)
        rows = written(rows.mapInArrow(_searching(sent, len(kept)), T.StructType([*rows.schema.fields[: len(kept) + 1], *HITS])), "hits")
        sent.destroy()
        group = more + list(islice(source, AT_ONCE - 1))
    sent = spark.sparkContext.broadcast(group)
    search = _searching(sent, len(kept))
    schema = T.StructType([*rows.schema.fields[: len(kept)], *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in search(batches):
            texts = texts_of(found.column(len(kept)))
            made = _results(texts, found.column(len(kept) + 1), found.column(len(kept) + 2), cleaned)
            columns = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[found.column(k) for k in range(len(kept))], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def _searching(sent: Broadcast, n_kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of kept columns and text, by chunks, with the hits of the sent blocks added to those that the rows bring along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, TEXT):
                words = words_of(texts, ALNUM, FOLDED_CODES)
                n = len(texts)
                parts = [(find(words, b), b.names) for b in sent.value] if len(words) else []
                none = np.zeros(0, np.int64)
                start, end = (np.concatenate([none, *[p[k] for p, _ in parts]]) for k in (0, 1))
                text_of = words.text[start] if len(start) else none
                held: list[set[str]] = [set() for _ in range(n)]
                for (_, _, t, i), names in parts:
                    for a, b in zip(t.tolist(), i.tolist(), strict=True):
                        held[a].add(names[b])
                order = np.argsort(text_of, kind="stable")
                per = np.searchsorted(text_of[order], np.arange(n + 1))
                base = words.first[text_of[order]]
                hits = [np.stack([start[order] - base, end[order] - base], axis=1)[a:b].ravel().tolist() for a, b in zip(per[:-1], per[1:], strict=True)]
                if part.num_columns > n_kept + 1:
                    before, names_before = (part.column(n_kept + k).to_pylist() for k in (1, 2))
                    hits = [a + b for a, b in zip(before, hits, strict=True)]
                    held = [a | set(b) for a, b in zip(held, names_before, strict=True)]
                columns = [*[part.column(k) for k in range(n_kept + 1)], pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in held], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[: n_kept + 1], *[f.name for f in HITS]])

    return run


def _results(texts: Texts, hits: pa.Array, items: pa.Array, cleaned: bool) -> list[object]:
    """The columns of ``FIELDS`` (and ``CLEANED``) from ranges of hit words and names of items."""
    words = words_of(texts, ALNUM, FOLDED_CODES)
    n = len(texts)
    flat = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    many = np.diff(hits.offsets.to_numpy()) // 2
    base = np.repeat(words.first[:-1], many)
    hit = covered(base + flat[:, 0], base + flat[:, 1], len(words))
    # Neighbouring hit words of a text belong to one span.
    text_of = words.text
    joined = hit[1:] & hit[:-1] & (text_of[1:] == text_of[:-1]) if len(words) else np.zeros(0, bool)
    first = np.flatnonzero(hit & ~np.append(False, joined)) if len(words) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & ~np.append(joined, False)) if len(words) else first
    base = texts.offsets[text_of[first]]
    a, b = words.start[first] - base, words.end[last] - base
    per = np.searchsorted(text_of[first], np.arange(n + 1))
    span = [pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]
    made: list[object] = [
        words.counts, totals(hit, words.first), items.cast(pa.list_(pa.field("element", pa.string(), False))),
        pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=span), type=pa.list_(pa.field("element", pa.struct(span), False))),
    ]
    if cleaned:
        out = []
        for i in range(n):
            raw, at, pieces = texts.bytes_of(i), 0, []
            for k in range(per[i], per[i + 1]):
                pieces.append(raw[at : a[k]])
                at = b[k]
            out.append(b" ".join([*pieces, raw[at:]]).decode())
        made.append(pa.array(out, pa.string()))
    return made


def digest(result: DataFrame) -> list[F.Column]:
    """Columns of the query over the operator's result."""
    items = F.col("items")
    return [
        F.col("n_words"), F.col("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    ]
