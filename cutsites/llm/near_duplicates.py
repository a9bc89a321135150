"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles (five words; all its words if it has fewer). A shingle's weight is its count times
1 + ln(N / df), with df taken as ``RARE`` N where it is less: only shingles in more than a thousandth of the documents need
their exact df, and there can be no more of them than the mean number of shingles a document has, divided by ``RARE``. That bounds
the table which tasks get. They are found exactly: a shingle frequent overall is frequent in a block of documents of some task;
such candidates are counted over all documents.

``BANDS`` x ``ROWS`` samples make band keys; documents with an equal key are candidates, and candidates with a weighted Jaccard
similarity of at least ``SIMILARITY`` are linked (see ``link_buckets``: large groups are never listed pair by pair). At exactly 0.8 a
pair has no common band with probability 0.0004 (0.00001 at 0.86).

Equal texts are one node from the start. Null, empty and wordless texts have no shingles and stay alone. Repeated rows and
rows with equal ids each get a row of the result; the class id is the smallest doc_id in a class (null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import ALNUM, FOLDED_CODES, Texts, chunks, mix, range_hash, running, texts_of, words_of
from cutsites.llm.common import TEXT, per_text, ship, written
from cutsites.llm.components import connected, link_buckets

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4
RARE = 1e-3
FILTER_BITS = 23
SMALL_CHUNK = 1 << 19
BLOCK_DOCS, BLOCK_SHINGLES = 4000, 8_000_000


def shingles(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle."""
    words = words_of(texts, ALNUM, FOLDED_CODES)
    at, hashes = words.windows(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = range_hash(running(words.hash), words.first[short], words.first[short + 1])
        return np.concatenate([words.text[at], short]), np.concatenate([hashes, whole])
    return words.text[at], hashes


def counted(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, sorted by (text, hash). A shingle's hash keeps its upper 48 bits."""
    both = text.astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16)
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    both = both[at]
    return (both >> np.uint64(48)).astype(np.int64), both << np.uint64(16), np.diff(np.append(at, len(text)))


class Weights:
    """Weights from counts: ``hashes`` (sorted) are the frequent shingles, ``idf`` theirs."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.rare = float(1 + np.log(1 / RARE))
        self.idf = 1 + np.log(max(n, 1) / np.maximum(df[order], RARE * n))

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return counts * self.rare
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return counts * np.where(self.hashes[at] == hashes, self.idf[at], self.rare)


def _flush(held: list[np.ndarray], docs: int) -> np.ndarray:
    values, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
    return values[n >= max(1, int(np.ceil(RARE * docs)))]


def frequent(docs: DataFrame, text: str = "text") -> Weights:
    """Document frequencies of all shingles in more than ``RARE`` of the documents."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(f"`{text}`").cast("string").alias(TEXT))
    n = docs.count()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(blocks: list[tuple[list[np.ndarray], int]]) -> pa.RecordBatch:
            found = _flush([h for b, _ in blocks for h in b], sum(d for _, d in blocks))
            return pa.RecordBatch.from_arrays([pa.array(np.unique(found >> np.uint64(64 - FILTER_BITS)).astype(np.int32))], names=["at"])

        ready: tuple[list[np.ndarray], int] = ([], 0)
        held: list[np.ndarray] = []
        docs_in = size = 0
        for batch in batches:
            for part, texts in chunks(batch, TEXT):
                _, hashes = shingles(texts)
                hashes = hashes >> np.uint64(16) << np.uint64(16)
                held.append(hashes)  # repeats in a text count too: more candidates, none less
                docs_in, size = docs_in + part.num_rows, size + len(hashes)
                if docs_in >= BLOCK_DOCS or size >= BLOCK_SHINGLES:
                    if ready[1]:
                        yield out([ready])
                    ready, held, docs_in, size = (held, docs_in), [], 0, 0
        if ready[1] or docs_in:
            yield out([ready, (held, docs_in)])  # a last, small block joins the one before

    # One bit for each hash prefix that some candidate has: at most 2**FILTER_BITS of them, whatever the input.
    rows = source.mapInArrow(candidates, "at int").distinct().toPandas()["at"].to_numpy()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[rows] = True
    packed = spark.sparkContext.broadcast(np.packbits(bits))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            for _, texts in chunks(batch, TEXT):
                text_, hashes = shingles(texts)
                some = flags[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                _, hashes, _ = counted(text_[some], hashes[some])
                values, m = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(m)], names=["h", "m"])

    df = source.mapInArrow(occurrences, "h long, m long").groupBy("h").agg(F.sum("m").alias("df")).where(F.col("df") > RARE * n).toPandas()
    return Weights(df["h"].to_numpy(np.int64).view(np.uint64), df["df"].to_numpy(float), n)


def _gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) law, P(x) = 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


# A sample needs c and r from Gamma(2, 1) and beta from [0, 1). The law is cut into 65,536 cells of equal probability; 16 bits choose the cell.
_CELLS = 1 << 16
_EDGES = np.concatenate([_gamma2(np.arange(_CELLS) / _CELLS), [np.inf]])
with np.errstate(divide="ignore"):
    _LN_LOW = np.log(_EDGES[:-1]).astype(np.float32)  # lower end of ln c; -inf in the first cell
_HIGH = _EDGES[1:].astype(np.float32)  # upper end of r; inf in the last cell
#: What float32 may take from a bound, and how far above the lowest bound elements are looked at first.
_SLACK, _NEAR = np.float32(1e-3), np.float32(3)

_multipliers = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def _gamma2_in(cell: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Values of the law in a cell at a place (0 to 1) inside it; the first and the last cell have their exact tails."""
    out = _EDGES[cell] + np.where(cell < _CELLS - 1, _EDGES[np.minimum(cell, _CELLS - 2) + 1] - _EDGES[cell], 0) * inside
    low = np.flatnonzero(cell == 0)
    if len(low):
        root = np.sqrt(2 * np.maximum(inside[low], 1e-9) / _CELLS)
        out[low] = root * (1 + root / 3)
    high = np.flatnonzero(cell == _CELLS - 1)
    if len(high):
        ln_p = np.log(np.maximum(1 - inside[high], 1e-9) / _CELLS)
        x = -ln_p
        for _ in range(20):  # P(> x) = (1 + x) exp(-x)
            x = np.log1p(x) - ln_p
        out[high] = x
    return out


def _drawn(draws: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and level t of elements: ln y = r (floor(ln w / r + beta) - beta), a = c / (y exp(r))."""
    first = mix(draws ^ np.uint64(0x9E3779B97F4A7C15))
    second = mix(first ^ np.uint64(0xD1B54A32D192ED03))
    place = lambda bits: (bits >> np.uint64(11)) * 2.0**-53
    c = _gamma2_in(((draws >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64), place(first))
    r = np.maximum(_gamma2_in((draws >> np.uint64(48)).astype(np.int64), place(second)), 1e-9)
    beta = place(mix(second ^ first))
    t = np.floor(ln_w / r + beta)
    return np.log(np.maximum(c, 1e-300)) - r * (t - beta + 1), t.astype(np.int64)


def samples(first: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples of each set; set i has elements ``first[i]`` to ``first[i + 1]``, at least one.

    The sample is the element with the smallest a = c / (y exp(r)), and its level. c, r and beta come from the element's hash and the number of
    the sample. As y is w at most, ln c - r - ln w bounds ln a from below, with the ends of the cells in place of c and r: two look-ups. Only the few
    elements (some ten for each set) whose bound is below the smallest a found so far are drawn exactly, tails included.
    """
    out = np.empty((len(first) - 1, n), np.uint64)
    starts = first[:-1]
    owner = np.repeat(np.arange(len(starts)), np.diff(first))
    ln_w = np.log(weights)
    ln_w32 = ln_w.astype(np.float32) + _SLACK
    for k in range(n):
        draws = hashes * _multipliers[k]
        cells = draws.view(np.uint16).reshape(-1, 4)
        bound = _LN_LOW[cells[:, 2]]
        bound -= _HIGH[cells[:, 3]]
        bound -= ln_w32
        lowest = np.minimum.reduceat(bound, starts)
        near = np.flatnonzero(bound <= (lowest + _NEAR)[owner])
        best = np.full(len(starts), np.inf)
        np.minimum.at(best, owner[near], _drawn(draws[near], ln_w[near])[0])
        at = np.flatnonzero(bound <= best.astype(np.float32)[owner] + _SLACK)
        ln_a, t = _drawn(draws[at], ln_w[at])
        np.minimum.at(best, owner[at], ln_a)
        smallest = ln_a == best[owner[at]]
        at, t = at[smallest], t[smallest]
        chosen = mix(hashes[at] ^ mix(t.view(np.uint64)))
        if len(at) == len(starts):
            out[:, k] = chosen
            continue
        # Of equal minima the smallest hash counts, so that the choice depends on the set only.
        order = np.lexsort((chosen, owner[at]))
        new = np.ones(len(at), bool)
        new[1:] = owner[at][order][1:] != owner[at][order][:-1]
        out[:, k] = chosen[order][new]
    return out


def band_keys(texts: Texts, weigh: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and their band keys."""
    text, hashes, counts = counted(*shingles(texts))
    some, first = np.unique(text, return_index=True)
    if not len(some):
        return some, np.zeros((0, BANDS), np.int64)
    drawn = samples(np.append(first, len(text)), hashes, weigh(hashes, counts), BANDS * ROWS)
    keys = np.zeros((len(some), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(some), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ drawn[:, b * ROWS + r])
        keys[:, b] = key
    return some, keys.view(np.int64)


def similarities(a: Texts, b: Texts, weigh: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of text i of ``a`` and text i of ``b``."""
    n = len(a)
    sides = [counted(*shingles(t)) for t in (a, b)]
    text = np.concatenate([s[0] for s in sides])
    hashes = np.concatenate([s[1] for s in sides])
    weights = np.concatenate([weigh(s[1], s[2]) for s in sides])
    both = text.astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16)
    order = np.argsort(both)
    text, both, weights = text[order], both[order], weights[order]
    twice = np.flatnonzero(both[1:] == both[:-1])
    shared = np.bincount(text[twice], np.minimum(weights[twice], weights[twice + 1]), n)
    total = np.bincount(text, weights, n)
    return shared / np.maximum(total - shared, 1e-300)


def connecting(texts: Texts, weigh: Weights, similarity: float, group: np.ndarray, split: int = 0) -> tuple[list[int], list[int]]:
    """Pairs with the similarity that connect all such pairs among some texts.

    Texts of one ``group`` are known to be connected. With ``split``, only pairs of a text before it and one from it on count.
    """
    text, hashes, counts = counted(*shingles(texts))
    weights = weigh(hashes, counts)
    some, first = np.unique(text, return_index=True)
    last = np.append(first[1:], len(text))
    _, element = np.unique(hashes, return_inverse=True)
    total = np.add.reduceat(weights, first) if len(some) else weights
    own = np.zeros(element.max() + 1 if len(element) else 0)
    group = group[some].copy()
    split = int(np.searchsorted(some, split))
    a, b = [], []
    for i in range(split or len(some) - 1):
        start = max(i + 1, split)
        if start >= len(some) or (group[start:] == group[i]).all():
            continue
        mine = slice(first[i], last[i])
        own[element[mine]] = weights[mine]
        later = slice(first[start], None)
        shared = np.add.reduceat(np.minimum(weights[later], own[element[later]]), first[start:] - first[start])
        own[element[mine]] = 0
        for j in np.flatnonzero(shared >= similarity * (total[i] + total[start:] - shared)) + start:
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                a.append(int(some[i]))
                b.append(int(some[j]))
    return a, b


NODE = "unhex(md5(`{text}`))"


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, root, class_id, class_size`` for every row; ``node`` is the md5 of the text, ``root`` the smallest node of the class (null
    without shingles), ``class_size`` counts rows."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.expr(NODE.format(text=text)).alias("node"), F.col(f"`{text}`").alias("text"))
    weigh = spark.sparkContext.broadcast(frequent(source))

    def keys(texts: Texts) -> dict[str, object]:
        """Band keys in pieces of the chunk small enough for the processor's cache."""
        out: list[pa.Array] = []
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(texts.offsets, texts.offsets[begin] + SMALL_CHUNK, "right")) - 1)
            low, high = texts.offsets[begin], texts.offsets[min(end, len(texts))]
            part = Texts(texts.data[low:high], texts.offsets[begin : end + 1] - low)
            some, made = band_keys(part, weigh.value)
            per = np.zeros(len(part) + 1, np.int32)
            per[some + 1] = BANDS
            out.append(pa.ListArray.from_arrays(pa.array(np.cumsum(per, dtype=np.int32)), pa.array(made.ravel())))
            begin = end
        return {"keys": pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))}

    field = T.StructField("keys", T.ArrayType(T.LongType()))
    sized = source.withColumn("size", F.octet_length("text"))
    signed = written(per_text(sized, keys, [field], ["doc_id", "node", "size"]), "signed")
    nodes = signed.where("size(keys) > 0").groupBy("node").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))
    buckets = nodes.select(F.explode("keys").alias("bucket"), "node", "size")
    shared = buckets.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = written(buckets.join(shared, "bucket"), "buckets")
    # The texts that any comparison needs: read once from the documents.
    needed = buckets.select("node").distinct()
    texts = written(source.select("node", "text").join(needed, "node", "left_semi").dropDuplicates(["node"]), "texts")

    def distances(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        joined = pairs.join(right, "b").join(left, "a").select("a", "b", "tb", "ta")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, ta in chunks(batch, "ta"):
                    begin = 0
                    for sub, tb in chunks(part, "tb"):
                        own = texts_of(sub.column(sub.schema.get_field_index("ta")))
                        d = 1 - similarities(own, tb, weigh.value)
                        yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(1), pa.array(d)], names=["a", "b", "d"])
                        begin += sub.num_rows

        return joined.mapInArrow(run, "a binary, b binary, d double")

    def inside(groups: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("second")
            nodes = table.column("node").combine_chunks()
            split = len(table) - pc.sum(table.column("second")).as_py()
            group = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
            a, b = connecting(texts_of(table.column("text")), weigh.value, similarity - 1e-9, group, split if split < len(table) else 0)
            return pa.table({"a": nodes.take(pa.array(a, pa.int64())), "b": nodes.take(pa.array(b, pa.int64()))})

        return groups.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")

    roots = connected(link_buckets(buckets, distances, 1 - similarity + 1e-9, inside))
    rows = signed.select("doc_id", "node", F.size("keys").alias("n")).join(roots, "node", "left")
    # Rows without shingles are alone: they must not meet in their common node.
    rows = rows.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    found = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    joined = rows.join(found, "root", "left")
    alone = F.col("root").isNull()
    return joined.select(
        "doc_id", "node", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class; rows without shingles all stay."""
    several = found.where("class_size > 1")
    # A class is its root, whatever its ids; its row is the first one by (no id, id, node).
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    first = several.groupBy("root").agg(F.min(place).alias("first")).select("first.doc_id", "first.node")
    i, n = F.col("doc_id").alias("__i"), F.col("node").alias("__n")
    node = F.expr(NODE.format(text=text))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__i")) & (node == F.col("__n"))
    ids = several.groupBy("doc_id", "node").agg(F.count("*").alias("rows"))
    gone = ids.join(first.select(i, n), F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("node") == F.col("__n")), "left_anti")
    kept = docs.join(gone.select(i, n), same, "left_anti")
    again = ids.where("rows > 1").select(i, n)
    if again.isEmpty():
        return kept
    # Of repeated rows one stays, the one with the smallest hash if other columns differ.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same, "left_semi").groupBy(F.col(f"`{doc_id}`").alias("__i"), node.alias("__n")).agg(F.min_by(row, F.md5(F.to_json(row))).alias("__row"))
    return kept.join(again, same, "left_anti").unionByName(one.select("__row.*"))
