"""Exact removal of repeated byte strings by sorting suffixes with the deep-shallow method.

Every 50-byte string of a text has an anchor: the smallest hash of its 20-byte strings (the first of equal ones). Equal strings have
equal anchors at equal offsets, so only strings whose anchor hash occurs in two documents can repeat across documents. The steps, each
of them a shuffle of packed arrays:

1. every text sends its anchor hashes to hash ranges, with the number of its text group;
2. a hash range tells text groups which of their hashes occur twice;
3. a text group sends, for these anchors, the stretch of text that holds all strings of the anchor (50 to 80 bytes, equal stretches of a
   group once, with their smallest document);
4. a hash range sorts the suffixes of its stretches that begin such strings: multikey quicksort by 8-byte characters to depth 16, then blind
   tries for groups with longer common prefixes (a trie compares a suffix with one other and branches at the first byte that differs).
   Strings equal over 50 bytes meet, and the smallest document of each goes back to the text groups;
5. a text group marks the strings that start in a smaller document and cuts the covered bytes.

Text groups (8 MB) and hash ranges (the anchors of 4 MB) grow in number with the input, not in size; rows equal in id and text that
exceed a group are spread over groups. A string that very many
documents share is sent once by each text group. Strings are judged on the input, not on what is left.

Null and empty texts have no bytes; texts under 50 bytes lose none. Documents with equal ids are not smaller than each other, so repeated
rows all keep what no smaller id has; a null id is larger than all others. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import BYTE_CODES, Texts, chunks, covered, range_hash, running, window_hashes
from cutsites.llm.common import TEXT, ship, written

LENGTH, ANCHOR = 50, 20
GROUP_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
SHALLOW = 16
_NO_ID = np.iinfo(np.int64).max
_LOW24 = np.uint64((1 << 24) - 1)


def anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: text, first and last start of the strings it stands for, and its hash (48 bits)."""
    data, n = texts.data, len(texts.data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = window_hashes(BYTE_CODES[data], ANCHOR)
    value = hashes & ~_LOW24
    value |= np.arange(len(value), dtype=np.uint64) & _LOW24
    width, have = LENGTH - ANCHOR + 1, 1
    while have * 2 <= width:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    value = np.minimum(value[: len(value) - (width - have)], value[width - have :])
    # Runs of starts with one anchor, cut at the texts' ends.
    new = np.zeros(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[texts.offsets[texts.offsets < len(value)]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(texts.offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(value)) - 1, texts.offsets[text + 1] - LENGTH)
    inside = last >= first
    first, last, text = first[inside], last[inside], text[inside]
    owner = first + ((value[first] & _LOW24).astype(np.int64) - first) % (1 << 24)
    return text, first, last, hashes[owner] >> np.uint64(16)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number that compares like them; ``data`` is padded by eight bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``data[s:s + depth]``, and for each place of the order whether it begins a group of equal strings."""
    n = len(starts)
    data = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    word = _words(data)
    order = np.argsort(word[starts].astype(np.uint64))
    begins = np.ones(n, bool)
    first = word[starts[order]]
    begins[1:] = first[1:] != first[:-1]

    def shared() -> np.ndarray:
        """Places in groups of at least two."""
        return ~(begins & np.append(begins[1:], True)) if n else begins

    def split(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Sort the places ``rows`` (whole groups) by keys inside their groups, and begin a group where a key changes."""
        by = np.lexsort([*keys[::-1], np.cumsum(begins)[rows]])
        order[rows] = order[rows][by]
        for key in keys:
            changed = np.zeros(len(rows), bool)
            changed[1:] = key[by][1:] != key[by][:-1]
            begins[rows] |= changed
        return by

    for at in range(8, shallow, 8):  # multikey quicksort: only groups of equals look at the next character
        rows = np.flatnonzero(shared())
        split(rows, word[starts[order[rows]] + at].astype(np.uint64))
    # Blind tries, one level of all groups at a time: a group's first member is the one that the others are compared with.
    open_ = shared()
    while open_.any():
        rows = np.flatnonzero(open_)
        own = starts[order[rows]]
        other = starts[order[np.flatnonzero(begins)[np.cumsum(begins)[rows] - 1]]]
        common = np.full(len(rows), depth)
        for at in reversed(range(shallow, depth, 8)):  # the difference found last is the first one
            differ = word[own + at].astype(np.uint64) ^ word[other + at].astype(np.uint64)
            if at + 8 > depth:
                differ >>= np.uint64(8 * (at + 8 - depth))
                differ <<= np.uint64(8 * (at + 8 - depth))
            found = np.flatnonzero(differ)
            equal_bytes = np.zeros(len(found), np.int64)
            for k in range(1, 8):
                equal_bytes += differ[found] < np.uint64(1 << (64 - 8 * k))
            common[found] = at + equal_bytes
        branch = np.where(common < depth, data[own + common], 0).astype(np.int64)
        side = np.where(common == depth, 1, np.where(branch < data[other + common], 0, 2))
        # Smaller strings branch off before the leader, the earlier the smaller; larger ones after it.
        by = split(rows, side, np.where(side == 0, common, -common), branch)
        open_ = np.zeros(n, bool)
        open_[rows] = side[by] != 1
        open_ &= shared()
    return order, begins


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, one behind the other, after that length."""
    n = len(next(iter(arrays.values())))
    return b"".join([np.int64(n).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays.values())])


def _squeeze(raw: bytes) -> bytes:
    """Compressed bytes after their length."""
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: bytes) -> bytes:
    size = int(np.frombuffer(packed, np.int64, 1)[0])
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""


def _unpack(payload: bytes, *types: type) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    out, at = [], 8
    for t in types:
        out.append(np.frombuffer(payload, t, n, at))
        at += n * np.dtype(t).itemsize
    return [*out, np.frombuffer(payload, np.uint8, offset=at)]


def _send(name: str, to: np.ndarray, payload) -> pa.RecordBatch:
    """One row for each receiver in ``to`` (sorted); ``payload(low, high)`` packs its part."""
    who, low = np.unique(to, return_index=True)
    high = np.append(low[1:], len(to))[: len(who)]
    packed = [payload(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(who.astype(np.int64)), pa.array(packed, pa.binary())], names=[name, "packed"])


def _received(table: pa.Table, *types: type, rest: Callable[[bytes], bytes] | None = None) -> list[np.ndarray]:
    """The arrays of all payloads, joined; last the bytes behind them."""
    parts = [_unpack(x, *types) for x in table.column("packed").to_pylist()]
    if rest:
        parts = [[*p[:-1], np.frombuffer(rest(p[-1].tobytes()), np.uint8)] for p in parts]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate([*types, np.uint8])]


def _ids(part: pa.RecordBatch) -> np.ndarray:
    ids = part.column(part.schema.get_field_index("__id"))
    return ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _stretch_keys(texts: Texts, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return range_hash(running(BYTE_CODES[texts.data]), first, last + LENGTH)


SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


def text_bytes(docs: DataFrame, text: str, *ids: str) -> tuple[int, int]:
    """Bytes of all texts, and the most that rows equal in text and ids have together (0 if all differ)."""
    keys = [F.col(f"`{c}`") for c in ids]
    sizes = docs.groupBy(*keys, F.md5(F.col(f"`{text}`").cast("string")).alias("__m")).agg(
        F.sum(F.expr(f"octet_length(cast(`{text}` as string))")).alias("__b"), F.count("*").alias("__k")
    )
    return tuple(x or 0 for x in sizes.agg(F.sum("__b"), F.max(F.expr("case when __k > 1 then __b end"))).first())


def text_groups(docs: DataFrame, kept: list[str], text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, int]:
    """Rows with their text, id and group, and the number of hash ranges.

    Rows equal in id and text would share a group. If they are more than a group holds, rows are numbered and spread by
    their number; the numbers are written, so that all readers see the same groups.
    """
    total, most = text_bytes(docs, text, doc_id)
    numbered = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(TEXT), F.col(f"`{doc_id}`").cast("long").alias("__id"),
    )
    keys = [F.col("__id"), F.col(TEXT)]
    if most > GROUP_BYTES:
        numbered = written(numbered.withColumn("__number", F.monotonically_increasing_id()), "numbered")
        keys.append(F.col("__number"))
    grouped = numbered.withColumn("__g", F.pmod(F.xxhash64(*keys), F.lit(total // GROUP_BYTES + 1)))
    return grouped.drop("__number"), total // RANGE_BYTES + 1


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows with ``n_bytes``, ``spans`` (byte ranges removed, in order) and ``kept_bytes`` (what remains); these replace columns of
    the same names."""
    spark = docs.sparkSession
    ship(spark)
    new = ("n_bytes", "spans", "kept_bytes")
    kept = [c for c in docs.columns if c not in new]
    source, n_ranges = text_groups(docs, kept, text, doc_id)
    carried = [c for c in kept if c != text]
    squeezed_schema = T.StructType([*[source.schema[c] for c in [*carried, "__id", "__g"]], T.StructField("__packed", T.BinaryType())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            packed = [None if x is None else _squeeze(x.encode()) for x in batch.column(at(TEXT)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in [*carried, "__id", "__g"]], pa.array(packed, pa.binary())], names=squeezed_schema.names)

    def expanded(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Slices of a text group with the texts back in place."""
        for batch in table.combine_chunks().to_batches(max_chunksize=4096):
            raw = pa.array([None if x is None else _expand(x).decode() for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], names=[*squeezed_schema.names[:-1], TEXT])

    def range_of(hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(n_ranges)).astype(np.int64)

    def hashes_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_h, found_g = [], []
            for part, texts in chunks(batch, TEXT):
                group = part.column(part.schema.get_field_index("__g")).to_numpy()
                which, _, _, h = anchors(texts)
                # Once for each text, then once for each group with a mark if it was there twice.
                pair = np.unique(h << np.uint64(16) | which.astype(np.uint64))
                found_h.append(pair >> np.uint64(16))
                found_g.append(group[(pair & np.uint64(0xFFFF)).astype(np.int64)])
            h, g = np.concatenate(found_h), np.concatenate(found_g)
            order = np.lexsort((h, g))
            h, g = h[order], g[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            at = np.flatnonzero(first)
            twice = np.diff(np.append(at, len(h))) > 1
            h, g = h[at], g[at]
            to = range_of(h)
            order = np.argsort(to, kind="stable")
            h, g, twice, to = h[order], g[order], twice[order], to[order]
            high, low = (h >> np.uint64(32)).astype(np.uint16), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield _send("r", to, lambda a, b: _pack(high=high[a:b], low=low[a:b], g=g[a:b].astype(np.int32), twice=twice[a:b]))

    def answer(table: pa.Table) -> pa.Table:
        high, low, g, twice, _ = _received(table, np.uint16, np.uint32, np.int32, np.bool_)
        h = (high.astype(np.uint64) << np.uint64(32)) | low
        values, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        n = n + np.bincount(inverse, twice, len(values)).astype(np.int64)
        good = n[inverse] > 1
        g, h = g[good], h[good]
        order = np.argsort(g, kind="stable")
        g, h = g[order], h[order]
        return pa.Table.from_batches([_send("g", g, lambda a, b: _pack(h=h[a:b]))])

    def stretches(texts_: pa.Table, known: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Texts, tuple[np.ndarray, ...]]]:
        """Per chunk: the anchors with known hashes, as text, first, last, stretch key and hash."""
        for batch in expanded(texts_):
            for part, texts in chunks(batch, TEXT):
                which, first, last, h = anchors(texts)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                which, first, last, h = which[hit], first[hit], last[hit], h[hit]
                yield part, texts, (which, first, last, _stretch_keys(texts, first, last), h)

    def stretches_out(texts_: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.unique(_received(answers, np.uint64)[0])
        keys, hs, ids, sizes, raws, owners = [], [], [], [], [], []
        group = texts_.column("__g")[0].as_py() if texts_.num_rows else 0
        for part, texts, (which, first, last, key, h) in stretches(texts_, known):
            size = last - first + LENGTH
            offset = np.concatenate([[0], np.cumsum(size)])
            raw = texts.data[np.repeat(first - offset[:-1], size) + np.arange(offset[-1])]
            keys.append(key), hs.append(h), ids.append(_ids(part)[which]), sizes.append(size), raws.append(raw)
        if not keys or not sum(map(len, keys)):
            return pa.Table.from_batches([_send("r", np.zeros(0, np.int64), None)])
        key, h, doc, size = (np.concatenate(x) for x in (keys, hs, ids, sizes))
        raw = np.concatenate(raws)
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, key))
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        at = np.flatnonzero(new)
        one = doc[order][at] == doc[order][np.append(at[1:], len(key)) - 1]
        chosen = order[at]
        to = range_of(h[chosen])
        by = np.argsort(to, kind="stable")
        chosen, one, to = chosen[by], one[by], to[by]

        def packed(a: int, b: int) -> bytes:
            c = chosen[a:b]
            end = np.cumsum(size[c])
            data = raw[np.repeat(begin[c] - end + size[c], size[c]) + np.arange(end[-1])]
            return _pack(key=key[c], g=np.full(b - a, group, np.int32), doc=doc[c], size=size[c].astype(np.uint8), one=one[a:b]) + _squeeze(data.tobytes())

        return pa.Table.from_batches([_send("r", to, packed)])

    def smallest(table: pa.Table) -> pa.Table:
        """For each stretch, runs of its strings with the smallest document that holds them."""
        key, g, doc, size, one, data = _received(table, np.uint64, np.int32, np.int64, np.uint8, np.bool_, rest=_expand)
        many = size.astype(np.int64) - LENGTH + 1
        begin = np.cumsum(size.astype(np.int64)) - size
        owner = np.repeat(np.arange(len(key)), many)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        order, begins = deep_shallow(data, begin[owner] + inner)
        least = np.zeros(len(owner), np.int64)
        if len(owner):
            lowest = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(begins))
            least[order] = lowest[np.cumsum(begins) - 1]
        # Runs of equal answers; useless where no document of the stretch is larger.
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(owner)) - 1
        who, answer_ = owner[at], least[at]
        useful = (answer_ < doc[who]) | ~one[who]
        at, last, who, answer_ = at[useful], last[useful], who[useful], answer_[useful]
        order = np.argsort(g[who], kind="stable")
        at, last, who, answer_ = at[order], last[order], who[order], answer_[order]
        return pa.Table.from_batches([_send("g", g[who], lambda a, b: _pack(key=key[who[a:b]], low=inner[at[a:b]].astype(np.uint8), high=inner[last[a:b]].astype(np.uint8), doc=answer_[a:b]))])

    out_fields = [T.StructField(c, T.StringType()) if c == text else source.schema[c] for c in kept] + [
        T.StructField("n_bytes", T.LongType(), False), T.StructField("spans", T.ArrayType(SPAN, False), False), T.StructField("kept_bytes", T.BinaryType(), False),
    ]
    span_type = pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]), False))

    def cut(texts_: pa.Table, answers: pa.Table) -> pa.Table:
        key, low, high, doc, _ = _received(answers, np.uint64, np.uint8, np.uint8, np.int64)
        order = np.argsort(key, kind="stable")
        key, low, high, doc = key[order], low[order].astype(np.int64), high[order].astype(np.int64), doc[order]
        out = []
        for batch in expanded(texts_):
            for part, texts in chunks(batch, TEXT):
                which, first, last, _ = anchors(texts)
                own = _stretch_keys(texts, first, last)
                a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
                runs = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(int((b - a).sum()))
                at = np.repeat(np.arange(len(own)), b - a)
                smaller = doc[runs] < _ids(part)[which[at]] if len(runs) else np.zeros(0, bool)
                at, runs = at[smaller], runs[smaller]
                gone = covered(first[at] + low[runs], first[at] + high[runs] + LENGTH, len(texts.data))
                edge = np.zeros(len(gone) + 1, bool)
                edge[texts.offsets] = True
                before, after = np.append(False, gone[:-1]), np.append(gone[1:], False)
                start = np.flatnonzero(gone & (~before | edge[:-1])) if len(gone) else np.zeros(0, np.int64)
                end = np.flatnonzero(gone & (~after | edge[1:])) + 1 if len(gone) else start
                per = np.searchsorted(start, texts.offsets)
                base = np.repeat(texts.offsets[:-1], np.diff(per))
                left = np.concatenate([[0], np.cumsum(~gone)])
                kept_data, cuts = texts.data[~gone], left[texts.offsets]
                spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], fields=list(span_type.value_type))
                columns = [part.column(part.schema.get_field_index(TEXT if c == text else c)) for c in kept]
                columns += [
                    pa.array(np.diff(texts.offsets)), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), spans, type=span_type),
                    pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(kept_data.tobytes())]),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, names=[*kept, *new]))
        return pa.Table.from_batches(out)

    texts_by_group = source.mapInArrow(squeeze, squeezed_schema).groupBy("__g")
    hashes = source.select(TEXT, "__g").mapInArrow(hashes_out, "r long, packed binary")
    answers = hashes.groupBy("r").applyInArrow(answer, "g long, packed binary")
    sent = texts_by_group.cogroup(answers.groupBy("g")).applyInArrow(stretches_out, "r long, packed binary")
    found = sent.groupBy("r").applyInArrow(smallest, "g long, packed binary")
    return texts_by_group.cogroup(found.groupBy("g")).applyInArrow(cut, T.StructType(out_fields))
