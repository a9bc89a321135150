"""Exact and near-equal lines by segment partition and banded bit-parallel edit distance.

Two lines are linked if they are equal or their edit distance, in code points, is at most the threshold of the shorter one: 0 below 32 code
points, 1 below 64, 2 from there. A line of threshold t is split into t + 1 segments of nearly equal length. t edits leave a segment
whole, so a longer line that is linked has this segment as a substring at one of few places, which follow from both lengths. A line therefore has
keys (length of the shorter line, segment, substring) for itself and for all lengths of shorter lines; linked lines share a key.

Keys go to hash ranges as packed arrays, and only those that two different lines have come back to the text groups; lines with such
keys are compared as ``link_buckets`` says, never all pairs of a bucket. Distances are exact up to twice the largest threshold.

Lines are split at \\n. Lines without a character that is not white space are no duplicates of each other. Null and empty texts have no other lines. A
class keeps its first line by (doc_id, line number, hash of the text), null ids last; repeated rows have equal first lines and both keep them. Other columns pass
through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import LEADS, NOT_SPACE, Texts, chunks, lines_of, mix, range_hash, running, texts_of
from cutsites.llm.common import TEXT, ship, written
from cutsites.llm.components import connected, link_buckets
from cutsites.llm.suffix_dedup import GROUP_BYTES, RANGE_BYTES, _pack, _received, _send, text_bytes

LIMIT = 2
#: Characters (pairs times columns) whose distances are computed at a time, the length from which equal ends are cut off first, and the number of
#: pairs below which they are taken one by one.
AT_ONCE, LONG, FEW = 1 << 21, 1024, 24
REACH = 2 * LIMIT  # distances are exact up to here


def threshold(length: np.ndarray) -> np.ndarray:
    return np.minimum(length // 32, LIMIT)


def _first_code(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1))


def _second_code(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))


_FIRST, _SECOND = _first_code(np.arange(1 << 16)), _second_code(np.arange(1 << 16))


def _coded(points: np.ndarray, known: np.ndarray, code) -> np.ndarray:
    """Codes of code points, looked up below 65,536."""
    wide = np.flatnonzero(points >= len(known))
    out = known[np.minimum(points, len(known) - 1)] if len(wide) else known[points]
    out[wide] = code(points[wide])
    return out


class Lines:
    """Lines of a chunk with a character: text, number in the text, byte range, code point range, id of 16 bytes."""

    def __init__(self, texts: Texts) -> None:
        lines = lines_of(texts)
        inside = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(NOT_SPACE[texts.data], out=inside[1:])
        good = inside[lines.end] > inside[lines.start]
        number = np.arange(len(lines)) - np.repeat(lines.first[:-1], lines.counts)
        self.text, self.number = lines.text[good], number[good]
        self.start, self.end = lines.start[good], lines.end[good]
        points = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(LEADS[texts.data], out=points[1:])
        self.low, self.high = points[self.start], points[self.end]
        codes = np.frombuffer(texts.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.prefix = running(_coded(codes, _FIRST, _first_code))
        other = running(_coded(codes, _SECOND, _second_code))
        length = (self.high - self.low).astype(np.uint64)
        self.first_id = range_hash(self.prefix, self.low, self.high)
        self.second_id = mix(range_hash(other, self.low, self.high) ^ length)

    def ids(self, rows: np.ndarray) -> pa.Array:
        data = np.stack([self.first_id[rows], self.second_id[rows]], axis=1).tobytes()
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * 16
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probe keys of lines: place in ``rows`` and key, each pair once."""
        low, size = self.low[rows], self.high[rows] - self.low[rows]
        line, key = [], []
        for shorter in range(LIMIT + 1):
            length = size - shorter  # of the shorter line
            t = threshold(np.maximum(length, 0))
            for limit in range(max(1, shorter), LIMIT + 1):
                own = np.flatnonzero(t == limit)
                if not len(own):
                    continue
                n = length[own]
                for i in range(limit + 1):
                    wide = n % (limit + 1)
                    base = n // (limit + 1)
                    extra = np.maximum(i - (limit + 1 - wide), 0)
                    begin, span = i * base + extra, base + (i >= limit + 1 - wide)
                    # Shifts that a match with fewer than t errors left and right of the segment allows.
                    for shift in range(max(-i, shorter - (limit - i)), min(i, shorter + (limit - i)) + 1):
                        at = begin + shift
                        fits = (at >= 0) & (at + span <= size[own])
                        o, a = own[fits], low[own[fits]] + at[fits]
                        seed = mix((n[fits] * 8 + i).astype(np.uint64))
                        line.append(o)
                        key.append(mix(range_hash(self.prefix, a, a + span[fits]) ^ seed))
        if not line:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pair = np.stack([np.concatenate(line).astype(np.uint64), np.concatenate(key)])
        order = np.lexsort(pair[::-1])
        pair = pair[:, order]
        new = np.ones(pair.shape[1], bool)
        new[1:] = (pair[:, 1:] != pair[:, :-1]).any(0)
        return pair[0, new].astype(np.int64), pair[1, new]


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], reach: int = REACH) -> np.ndarray:
    """Edit distances of pairs, exact up to ``reach`` and ``reach + 1`` beyond, all pairs at once.

    A word of 2 * reach + 2 bits holds the rows around the diagonal of one column: vertical differences of the distance table. The word moves down one row
    with each column; the value at its lowest row is followed along the diagonal, then along the last row. Pairs are taken in the order of
    length, as many at a time as ``AT_ONCE`` characters; long lines first lose what they have in common at both ends, which changes no distance.
    """
    n = len(a)
    a, b = list(a), list(b)
    for k in range(n):
        if max(len(a[k]), len(b[k])) > LONG and abs(len(a[k]) - len(b[k])) <= reach:
            a[k], b[k] = _without_equal_ends(a[k], b[k])
    out = np.full(n, reach + 1, np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    todo = np.flatnonzero((np.abs(la - lb) <= reach) & (la > reach) & (lb > 0))
    short = np.flatnonzero((np.abs(la - lb) <= reach) & ((la <= reach) | (lb == 0)))
    for k in short:  # no room for the band: the plain table of at most reach + 1 rows
        row = np.arange(len(b[k]) + 1)
        for i, x in enumerate(a[k]):
            step = np.minimum(row[1:] + 1, row[:-1] + (b[k] != x))
            new = [i + 1]
            for v in step.tolist():
                new.append(min(v, new[-1] + 1))
            row = np.array(new)
        out[k] = min(int(row[-1]), reach + 1)
    width = 2 * reach + 2
    todo = todo[np.argsort(lb[todo], kind="stable")]
    begin = 0
    while begin < len(todo):
        room = np.arange(1, len(todo) - begin + 1) * lb[todo[begin:]] <= AT_ONCE
        end = begin + min(max(int(room.sum()), 1), 2048)  # the products grow
        rows, begin = todo[begin:end], end
        if len(rows) < FEW:
            out[rows] = [_one_distance(a[k], b[k], reach) for k in rows.tolist()]
            continue
        na, nb = la[rows], lb[rows]
        columns = int(nb.max())
        pad = width - reach - 1  # rows above the first character
        x = np.full((columns + width + reach, len(rows)), -1, np.int64)
        y = np.full((columns, len(rows)), -2, np.int64)
        for j, r in enumerate(rows):
            x[pad : pad + min(len(a[r]), len(x) - pad), j] = a[r][: len(x) - pad]
            y[: len(b[r]), j] = b[r]
        full = (1 << width) - 1
        vp = np.full(len(rows), full & ~((1 << (width - reach - 1)) - 1), np.int64)
        vn = np.zeros(len(rows), np.int64)
        value = np.full(len(rows), reach, np.int64)
        bits = (1 << np.arange(width)).astype(np.int64)[:, None]
        for j in range(columns):
            same = ((x[j : j + width] == y[j]) * bits).sum(0)
            d0 = ((((same & vp) + vp) ^ vp) | same | vn) & full
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp
            down = j < na - reach
            value += np.where(down, (d0 >> (width - 1)) ^ 1, 0)
            along = ~down & (j < nb)
            at = np.clip(width - 2 - (j - (na - reach)), 0, width - 1)
            value += np.where(along, ((hp >> at) & 1) - ((hn >> at) & 1), 0)
            vp = (hn | ~((d0 >> 1) | hp)) & full
            vn = (d0 >> 1) & hp
        out[rows] = np.minimum(value, reach + 1)
    return out


def _one_distance(a: np.ndarray, b: np.ndarray, reach: int) -> int:
    """The same for one pair: a column is a few operations on plain numbers, which long lines in small blocks need."""
    width = 2 * reach + 2
    pad, full, n = width - reach - 1, (1 << width) - 1, len(a)
    x = np.full(len(b) + width + reach, -1, np.int64)
    x[pad : pad + min(n, len(x) - pad)] = a[: len(x) - pad]
    vp, vn, value = full & ~((1 << pad) - 1), 0, reach
    for begin in range(0, len(b), 1 << 16):
        part = b[begin : begin + (1 << 16)]
        equal = np.zeros(len(part), np.int64)
        for i in range(width):
            equal |= (x[begin + i : begin + i + len(part)] == part).astype(np.int64) << i
        for j, same in enumerate(equal.tolist(), begin):
            d0 = ((((same & vp) + vp) ^ vp) | same | vn) & full
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp
            if j < n - reach:
                value += (d0 >> (width - 1)) ^ 1
            else:
                at = min(max(width - 2 - (j - (n - reach)), 0), width - 1)
                value += ((hp >> at) & 1) - ((hn >> at) & 1)
            vp = (hn | ~((d0 >> 1) | hp)) & full
            vn = (d0 >> 1) & hp
    return min(value, reach + 1)


def _without_equal_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    first = int(differ[0]) if len(differ) else n
    a, b, n = a[first:], b[first:], n - first
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    last = n - 1 - int(differ[-1]) if len(differ) else n
    return a[: len(a) - last], b[: len(b) - last]


def _points(texts: Texts) -> list[np.ndarray]:
    return [np.frombuffer(texts.bytes_of(i).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for i in range(len(texts))]


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, line_no, node`` of every line with a character; equal lines have equal nodes."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(f"`{text}`").cast("string").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, TEXT):
                lines = Lines(texts)
                ids, hashes = (part.column(k).take(pa.array(lines.text)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(lines.number), lines.ids(np.arange(len(lines.text)))], names=["doc_id", "text_hash", "line_no", "node"])

    return source.mapInArrow(run, "doc_id long, text_hash long, line_no long, node binary")


def text_groups(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """Texts with their group, and the number of hash ranges; if equal texts are more than a group holds, each text once."""
    total, most = text_bytes(docs, text)
    texts = docs.select(F.col(f"`{text}`").cast("string").alias(TEXT))
    if most > GROUP_BYTES:
        texts = written(texts.groupBy(F.md5(TEXT).alias("m")).agg(F.first(TEXT).alias(TEXT)).select(TEXT), "texts")
    return texts.withColumn("g", F.pmod(F.xxhash64(TEXT), F.lit(total // GROUP_BYTES + 1))), total // RANGE_BYTES + 1


def near_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``node, root`` of all lines that have a link to a different line."""
    ship(docs.sparkSession)
    source, n_ranges = text_groups(docs, text)

    def different(lines: Lines) -> np.ndarray:
        """Lines long enough for a link, equal ones once."""
        rows = np.flatnonzero(threshold(lines.high - lines.low) > 0)
        _, first = np.unique(lines.second_id[rows], return_index=True)
        return rows[first]

    def keys_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_h, all_mark, all_g = [], [], []
            for part, texts in chunks(batch, TEXT):
                lines = Lines(texts)
                rows = different(lines)
                line, key = lines.keys(rows)
                group = part.column(1).to_numpy()[lines.text[rows]]
                all_h.append(key >> np.uint64(16)), all_mark.append(lines.second_id[rows][line]), all_g.append(group[line])
            h, mark, g = np.concatenate(all_h), np.concatenate(all_mark), np.concatenate(all_g)
            to = (h % np.uint64(n_ranges)).astype(np.int64)
            order = np.lexsort((h, g, to))
            h, mark, g, to = h[order], mark[order], g[order], to[order]
            yield _send("r", to, lambda a, b: _pack(high=(h[a:b] >> np.uint64(32)).astype(np.uint16), low=h[a:b].astype(np.uint32), g=g[a:b].astype(np.int32), mark=mark[a:b]))

    def answer(table: pa.Table) -> pa.Table:
        """To text groups, their keys that different lines have, and the marks of the lines that have such keys."""
        high, low, g, mark, _ = _received(table, np.uint16, np.uint32, np.int32, np.uint64)
        h = (high.astype(np.uint64) << np.uint64(32)) | low
        order = np.lexsort((mark, h))
        h, mark, g = h[order], mark[order], g[order]
        # A key of different lines has two marks (64 bits of the line's id).
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(h))
        good = np.repeat(mark[begin] != mark[end - 1], end - begin) if len(h) else new
        group = g[good].astype(np.uint64)
        keys, marks = (np.unique(np.stack([group, x[good]]), axis=1) for x in (h, mark))

        def packed(a: int, b: int) -> bytes:
            low, high = (np.searchsorted(marks[0], keys[0][a], side) for side in ("left", "right"))
            return _pack(h=keys[1][a:b]) + marks[1][low:high].tobytes()

        return pa.Table.from_batches([_send("g", keys[0], packed)])

    def lines_out(texts_: pa.Table, answers: pa.Table) -> pa.Table:
        known, marks = _received(answers, np.uint64)
        known, marks = np.unique(known), np.unique(marks.view(np.uint64))
        out = []
        for batch in texts_.combine_chunks().to_batches():
            for _, texts in chunks(batch, TEXT):
                lines = Lines(texts)
                rows = different(lines)
                if not len(marks) or not len(rows):
                    continue
                own = lines.second_id[rows]  # only lines with a shared key are cut into keys again
                rows = rows[marks[np.minimum(np.searchsorted(marks, own), len(marks) - 1)] == own]
                line, key = lines.keys(rows)
                h = key >> np.uint64(16)
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                line, key = line[hit], key[hit]
                some, first = np.unique(line, return_index=True)
                keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(line)).astype(np.int32)), pa.array(key.view(np.int64)))
                raw = [texts.data[lines.start[r] : lines.end[r]].tobytes().decode("utf-8", "surrogatepass") for r in rows[some]]
                out.append(pa.RecordBatch.from_arrays([lines.ids(rows[some]), pa.array(raw, pa.string()), keys], names=["node", "line", "keys"]))
        if not out:
            return pa.table({"node": pa.array([], pa.binary()), "line": pa.array([], pa.string()), "keys": pa.array([], pa.list_(pa.int64()))})
        return pa.Table.from_batches(out)

    hashes = source.mapInArrow(keys_out, "r long, packed binary")
    answers = hashes.groupBy("r").applyInArrow(answer, "g long, packed binary")
    found = source.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(lines_out, "node binary, line string, keys array<long>")
    lines = written(found.dropDuplicates(["node"]), "lines")
    buckets = lines.select(F.explode("keys").alias("bucket"), "node", F.octet_length("line").alias("size"))
    shared = buckets.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = written(buckets.join(shared, "bucket"), "buckets")

    def distances(pairs: DataFrame) -> DataFrame:
        left, right = lines.select(F.col("node").alias("a"), F.col("line").alias("ta")), lines.select(F.col("node").alias("b"), F.col("line").alias("tb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, tb in chunks(batch, "tb"):
                    x, y = _points(texts_of(part.column(2))), _points(tb)
                    apart = [np.abs(np.bincount(p & 31, minlength=32) - np.bincount(q & 31, minlength=32)).sum() for p, q in zip(x, y, strict=True)]
                    near = np.flatnonzero(np.array(apart) <= 2 * REACH)  # each edit changes two counts at most
                    d = np.full(len(x), REACH + 1, np.int64)
                    d[near] = edit_distances([x[k] for k in near], [y[k] for k in near])
                    limit = threshold(np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d.astype(float)), pa.array(d <= limit)], names=["a", "b", "d", "linked"])

        return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, d double, linked boolean")

    def inside(groups: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            nodes, points = table.column("node").combine_chunks(), _points(texts_of(table.column("line")))
            size = np.array([len(x) for x in points], np.int64)
            second = table.column("second").to_numpy()
            root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
            i, j = np.triu_indices(len(points), 1)
            near = (np.abs(size[i] - size[j]) <= LIMIT) & (root[i] != root[j]) & ((second[i] != second[j]) | (not second.any()))
            i, j = i[near], j[near]
            # An edit changes two counts of characters at most: cheaper than a distance, and never wrong.
            counts = np.stack([np.bincount(p & 31, minlength=32) for p in points])
            near = np.abs(counts[i] - counts[j]).sum(1) <= 2 * LIMIT
            i, j = i[near], j[near]
            linked = edit_distances([points[k] for k in i], [points[k] for k in j], LIMIT) <= threshold(np.minimum(size[i], size[j]))
            return pa.table({"a": nodes.take(pa.array(i[linked])), "b": nodes.take(pa.array(j[linked]))})

        return groups.join(lines.select("node", "line"), "node").groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")

    return connected(link_buckets(buckets, distances, LIMIT, inside, max_members=128))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, class_doc_id, class_line_no, class_size, is_first, text_hash`` of every line with a character.

    A class is a connected component of links; it is named by its first line. Texts with one id, or none, are told apart by their hash.
    """
    lines = occurrences(docs, doc_id, text).join(near_lines(docs, text), "node", "left")
    lines = written(lines.select("doc_id", "text_hash", "line_no", F.coalesce("root", "node").alias("root")), "places")  # used twice
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "text_hash")
    first = lines.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("class_size"))
    return lines.join(first, "root").select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "class_size", (place.eqNullSafe(F.col("first"))).alias("is_first"), "text_hash"
    )


def clean(docs: DataFrame, found: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``text`` less the lines that repeat an earlier one, and ``n_removed_lines``."""
    found = classes(docs, doc_id, text) if found is None else found
    gone = found.where(~F.col("is_first")).groupBy(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h")).agg(F.collect_set("line_no").alias("__gone"))
    kept = [c for c in docs.columns if c not in (text, "n_removed_lines")]
    rows = docs.join(gone, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__i")) & (_text_hash(text) == F.col("__h")), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(TEXT), "__gone")
    fields = [*rows.schema.fields[:-2], T.StructField(text, T.StringType()), T.StructField("n_removed_lines", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for raw, lost in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                lost = set(lost or ())
                texts.append("\n".join(x for k, x in enumerate(raw.split("\n")) if k not in lost) if lost else raw)
                counts.append(len(lost))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*kept, text, "n_removed_lines"])

    return rows.mapInArrow(run, T.StructType(fields))
