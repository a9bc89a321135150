"""Removal of repeated word sequences, found through fixed blocks.

A document is cut into blocks of 18 words that do not overlap; they are the index. Every rolling window of 18 words of every document
probes it. A sequence of 35 words holds a whole block wherever it starts, so two places with the same 35 words share a probe that
hits a block. Hits are then extended over the words beside them: all sequences of 35 words that hold a hit are compared, and those that
are found at two places cover the maximal exact repeats. The steps, each of them a shuffle of packed arrays:

1. texts go to text groups; a text group sends its windows, each once, as 48 bits with two marks (begins a block; found twice) to hash
   ranges;
2. a hash range tells text groups which of their windows are a block that is found at two places;
3. a text group sends the sequences around these hits, each once, as 96 bits to hash ranges;
4. a hash range tells text groups which of their sequences are found at two places;
5. a text group marks the covered words and joins the others.

No pair of places is ever made: a range counts the places of a window or a sequence, however many there are, and a text group sends each
once, with a mark if it has it twice. Text groups (8 MB) and hash ranges (the windows of 8 MB) grow in number with the
input, not in size; one window that every text group has is one entry for each group. Rows equal in id and text that exceed a group
are spread over groups. Sequences are equal if their 96 bits are (at 10**13 sequences the chance of any wrong one is about 10**-3); the 48
bits only choose what is compared.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have none and become empty; texts under 35 words lose none. All
places count, repeated rows and places of one document too, and every copy loses the sequence. Other columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import BYTE_CODES, NOT_SPACE, Texts, Words, chunks, covered, mix, range_hash, running, totals, words_of
from cutsites.llm.common import TEXT, ship, written

LENGTH, BLOCK = 35, 18
GROUP_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Codes of bytes for the second hash of a word.
OTHER_CODES = mix(BYTE_CODES ^ np.uint64(0x5851F42D4C957F2D))
SENT = "r long, g long, keys binary, more binary, marks binary"
ANSWER = "g long, keys binary, more binary"
SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences, byte by byte of the same place, compressed."""
    steps = np.diff(numbers, prepend=np.zeros(1, np.uint64))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def range_of(numbers: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Range of each number below ``2**bits``; ranges are in the order of numbers."""
    return ((numbers >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)


def parts(to: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal values of a sorted array."""
    who, low = np.unique(to, return_index=True)
    for r, a, b in zip(who.tolist(), low.tolist(), np.append(low[1:], len(to))[: len(who)].tolist(), strict=True):
        yield r, slice(a, b)


def begins(*keys: np.ndarray) -> np.ndarray:
    """First places of equal rows of sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def probes(words: Words, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``block`` words of texts with a sequence: first word, 48 bits of hash, whether it begins a block."""
    at, h = words.windows(block)
    text = words.text[at]
    long = words.counts[text] >= length
    at, h, text = at[long], h[long], text[long]
    return at, h >> np.uint64(16), (at - words.first[text]) % block == 0


def second_hash(texts: Texts, words: Words, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """32 bits more of the sequences that begin at the words ``at``, from other hashes of the same words."""
    hashes = range_hash(running(OTHER_CODES[texts.data]), words.start, words.end)
    return range_hash(running(hashes), at, at + length) >> np.uint64(32)


def around(words: Words, hits: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that hold one of the windows that begin at the words ``hits``: first word and 64 bits of hash."""
    at, h = words.windows(length)
    flags = np.zeros(len(words) + 1, np.int64)
    flags[hits + 1] = 1
    before = np.cumsum(flags)
    holds = before[at + length - block + 1] > before[at]
    return at[holds], h[holds]


def spread(docs: DataFrame, kept: list[str], text: str, doc_id: str) -> tuple[DataFrame, int]:
    """Rows with their text and text group, and the number of hash ranges."""
    key, whole = F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string")
    sizes = docs.groupBy(key.alias("k"), F.md5(whole).alias("m")).agg(F.sum(F.octet_length(whole)).alias("b"), F.count("*").alias("n"))
    total, most = (x or 0 for x in sizes.agg(F.sum("b"), F.max(F.expr("case when n > 1 then b end"))).first())
    rows, keys = docs.select(*[F.col(f"`{c}`") for c in kept], whole.alias(TEXT), key.alias("__key")), ["__key", TEXT]
    if most > GROUP_BYTES:  # numbers are written, so that all readers see the same groups
        rows, keys = written(rows.withColumn("__number", F.monotonically_increasing_id()), "anchors"), [*keys, "__number"]
    return rows.withColumn("__g", F.pmod(F.xxhash64(*keys), F.lit(total // GROUP_BYTES + 1))).select(*kept, TEXT, "__g"), total // RANGE_BYTES + 1


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows with ``n_words``, ``n_removed``, ``spans`` (ranges of removed words, in order) and ``kept_text`` (the other words
    joined by one space); these replace columns of the same names."""
    ship(docs.sparkSession)
    new = ("n_words", "n_removed", "spans", "kept_text")
    kept = [c for c in docs.columns if c not in new]
    source, n_ranges = spread(docs, kept, text, doc_id)
    carried = [c for c in kept if c != text]
    squeezed = T.StructType([*[source.schema[c] for c in [*carried, "__g"]], T.StructField("__packed", T.BinaryType())])

    def squeezing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            packed = [None if x is None else squeeze(x.encode()) for x in batch.column(at(TEXT)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in [*carried, "__g"]], pa.array(packed, pa.binary())], names=squeezed.names)

    def opened(group: pa.Table) -> Iterator[tuple[pa.RecordBatch, Texts, Words]]:
        """Chunks of a text group with their texts and words."""
        for batch in group.combine_chunks().to_batches(max_chunksize=4096):
            raw = pa.array([None if x is None else expand(x).decode() for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            whole = pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], names=[*squeezed.names[:-1], TEXT])
            for part, texts in chunks(whole, TEXT):
                yield part, texts, words_of(texts, NOT_SPACE, BYTE_CODES)

    def sent(g: int, to: np.ndarray, keys: np.ndarray, more: np.ndarray, marks: np.ndarray) -> pa.Table:
        rows = [(r, g, pack(keys[s]), more[s].tobytes(), squeeze(marks[s].tobytes())) for r, s in parts(to)]
        types = [("r", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("marks", pa.binary())]
        return pa.table({n: pa.array([row[i] for row in rows], t) for i, (n, t) in enumerate(types)})

    def group_of(group: pa.Table) -> int:
        return group.column("__g")[0].as_py() if group.num_rows else 0

    def windows_out(group: pa.Table) -> pa.Table:
        found = [probes(words)[1:] for _, _, words in opened(group)]
        h, block = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, bool), zip(*found) if found else ((), ()), strict=True))
        order = np.argsort(h)
        h, block = h[order], block[order]
        at = begins(h)
        marks = np.diff(np.append(at, len(h))) > 1
        if len(at):
            marks = marks | (np.logical_or.reduceat(block, at).astype(np.uint8) << 1)
        return sent(group_of(group), range_of(h[at], 48, n_ranges), h[at], np.zeros((len(at), 0), np.uint8), marks.astype(np.uint8))

    def received(table: pa.Table, more: str | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        keys = [unpack(x) for x in table.column("keys").to_pylist()]
        rest = [np.frombuffer(x, more) for x in table.column("more").to_pylist()] if more else []
        return keys, rest, [np.frombuffer(expand(x), np.uint8) for x in table.column("marks").to_pylist()]

    def answers(table: pa.Table, found: np.ndarray, keys: list[np.ndarray], more: Iterable[np.ndarray]) -> pa.Table:
        """To the sender of each row, its keys that are found."""
        cuts = np.cumsum([0, *map(len, keys)])
        rows = []
        for g, k, m, a, b in zip(table.column("g").to_pylist(), keys, more, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if found[a:b].any():
                rows.append((g, pack(k[found[a:b]]), m[found[a:b]].tobytes()))
        return pa.table({n: pa.array([row[i] for row in rows], t) for i, (n, t) in enumerate([("g", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])})

    def hit(table: pa.Table) -> pa.Table:
        """Windows that are a block and are found at two places."""
        keys, _, marks = received(table, None)
        h, mark = np.concatenate(keys), np.concatenate(marks)
        order = np.argsort(h)
        at = begins(h[order])
        places = np.diff(np.append(at, len(h))) + np.add.reduceat((mark[order] & 1).astype(np.int64), at)
        good = (places > 1) & (np.bitwise_or.reduceat(mark[order], at) >> 1 == 1)
        found = np.zeros(len(h), bool)
        found[order] = np.repeat(good, np.diff(np.append(at, len(h))))
        return answers(table, found, keys, [np.zeros((len(k), 0), np.uint8) for k in keys])

    def sequences_out(group: pa.Table, hits: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(unpack, hits.column("keys").to_pylist())]))
        firsts, seconds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for _, texts, words in opened(group) if len(known) else ():
            at, h, _ = probes(words)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at, h = around(words, at[known[place] == h])
            if len(at):
                firsts.append(h)
                seconds.append(second_hash(texts, words, at).astype(np.uint32))
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        at = begins(first, second)
        twice = np.diff(np.append(at, len(first))) > 1
        return sent(group_of(group), range_of(first[at], 64, n_ranges), first[at], second[at], twice)

    def repeated(table: pa.Table) -> pa.Table:
        """Sequences that are found at two places."""
        keys, seconds, marks = received(table, "<u4")
        first, second, mark = np.concatenate(keys), np.concatenate(seconds), np.concatenate(marks)
        order = np.lexsort((second, first))
        at = begins(first[order], second[order])
        n = np.diff(np.append(at, len(first)))
        found = np.zeros(len(first), bool)
        found[order] = np.repeat(n + np.add.reduceat(mark[order].astype(np.int64), at) > 1, n)
        return answers(table, found, keys, [(s >> 16).astype(np.uint16) for s in seconds])

    span_type = pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]), False))
    out_fields = [T.StructField(c, T.StringType()) if c == text else source.schema[c] for c in kept] + [
        T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False),
        T.StructField("spans", T.ArrayType(SPAN, False), False), T.StructField("kept_text", T.StringType(), False),
    ]

    def cut(group: pa.Table, repeats: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *map(unpack, repeats.column("keys").to_pylist())])
        rest = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(x, np.uint16) for x in repeats.column("more").to_pylist()]])
        order = np.argsort(known, kind="stable")
        known, rest = known[order], rest[order]
        out = []
        for part, texts, words in opened(group):
            at, h = words.windows(LENGTH)
            a, b = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            match = np.flatnonzero(b > a)
            at, a, b = at[match], a[match], b[match]
            if len(at):
                own, same = (second_hash(texts, words, at) >> np.uint64(16)).astype(np.uint16), np.zeros(len(at), bool)
                for k in range(int((b - a).max())):  # more than one only if 64 bits agree by chance
                    same |= (a + k < b) & (rest[np.minimum(a + k, len(rest) - 1)] == own)
                at = at[same]
            gone = covered(at, at + LENGTH, len(words))
            starts, ends = edges(gone, words.first)
            per = np.searchsorted(starts, words.first)
            base = np.repeat(words.first[:-1], np.diff(per))
            spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], fields=list(span_type.value_type))
            data, offsets = joined(texts, words, ~gone)
            columns = [part.column(part.schema.get_field_index(TEXT if c == text else c)) for c in kept]
            columns += [
                pa.array(words.counts.astype(np.int64)), pa.array(totals(gone, words.first)),
                pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), spans, type=span_type),
                pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names=[*kept, *new]))
        return pa.Table.from_batches(out)

    texts_by_group = source.mapInArrow(squeezing, squeezed).groupBy("__g")
    hits = texts_by_group.applyInArrow(windows_out, SENT).groupBy("r").applyInArrow(hit, ANSWER)
    found = texts_by_group.cogroup(hits.groupBy("g")).applyInArrow(sequences_out, SENT).groupBy("r").applyInArrow(repeated, ANSWER)
    return texts_by_group.cogroup(found.groupBy("g")).applyInArrow(cut, T.StructType(out_fields))


def edges(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True that do not cross a text's first word."""
    n = len(flags)
    border = np.zeros(n + 1, bool)
    border[first] = True
    before, after = np.append(False, flags[:-1]), np.append(flags[1:], False)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.flatnonzero(flags & (~before | border[:-1])), np.flatnonzero(flags & (~after | border[1:])) + 1


def joined(texts: Texts, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all texts, joined by one space inside a text, and the offsets of texts."""
    chosen = np.flatnonzero(keep)
    start, size = words.start[chosen], words.end[chosen] - words.start[chosen]
    last = np.zeros(len(chosen), bool)  # no space behind the last kept word of a text
    cuts = np.searchsorted(chosen, words.first)
    some = cuts[1:] > cuts[:-1]
    last[cuts[1:][some] - 1] = True
    room = size + ~last
    end = np.cumsum(room)
    total = int(end[-1]) if len(end) else 0
    source = np.repeat(start - (end - room), room) + np.arange(total)
    data = texts.data[np.minimum(source, max(len(texts.data) - 1, 0))] if total else np.zeros(0, np.uint8)
    data[end[~last] - 1] = 0x20
    return data, np.concatenate([[0], end])[cuts]
