"""Random access to genome FASTA: an index of byte ranges, and tasks that read only the ranges of wanted windows.

A plain file is cut into ranges of 64 KB, a block-compressed one (gzip members that state their size, as genome tools write them) into
its blocks. One pass over all ranges, in parallel, counts bases; running sums over the ranges of a file then tell which bases of which record
each range holds. Lines may have any length: a record of one line is as many ranges as its bytes need. A window is one
equi-join with the index (its contig and the tile of its first base), and one read from there on.

The index has one row for 64 KB of genome and the running sums of a file are one task's work: 50,000 rows for a genome of 3 GB. Executors read
files by offset through the file systems of Arrow (local and shared folders, object stores, HDFS). Files that are compressed in one piece have
no ranges and are rejected; ``write_blocked`` writes blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cutsites.session import broadcast_if_small, ship

RANGE_BYTES = 1 << 16
TILE_BITS = 16
#: Uncompressed bytes of a block that is written; its size must stay below 64 KB compressed too.
BLOCK_BYTES = 60_000
INDEX = "file string, at bigint, skip bigint, chr string, lo bigint, hi bigint"
# Fixed values of the block-compressed format: the header up to the size of the block, and the empty block that ends a file.
_BLOCK_HEADER = bytes.fromhex("1f8b08040000000000ff060042430200")
_LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_GZIP = b"\x1f\x8b"
_NEWLINE, _OPENS = 10, ord(">")
_SPACES = np.frombuffer(b"\n\r\t ", np.uint8)


def _uri(path: str) -> str:
    """A path as Spark names it (``/a``, ``file:/a``, ``file:///a``, ``s3://b/a``) as a full URI."""
    plain = path.removeprefix("file:")
    return path if "://" in path else f"file:///{plain.lstrip('/')}"


class GenomeFile:
    """Bytes of one file from any range on."""

    def __init__(self, uri: str, range_bytes: int = RANGE_BYTES) -> None:
        system, path = fs.FileSystem.from_uri(_uri(uri))
        self.file, self.range_bytes, self.bytes_read = system.open_input_file(path), range_bytes, 0
        self.size = self.file.size()
        self.compressed = self._at(0, 2) == _GZIP

    def _at(self, offset: int, n: int) -> bytes:
        data = self.file.read_at(min(n, max(self.size - offset, 0)), offset)
        self.bytes_read += len(data)
        return data

    def block_size(self, offset: int) -> int:
        """Size of the compressed block at an offset, from its header."""
        head = self._at(offset, 12)
        extra = self._at(offset + 12, struct.unpack("<H", head[10:12])[0]) if len(head) == 12 and head[:2] == _GZIP and head[3] & 4 else b""
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"BC" and n == 2:
                return struct.unpack("<H", extra[4:6])[0] + 1
            extra = extra[4 + n :]
        raise ValueError("a file compressed in one piece has no ranges: write it in blocks")

    def pieces(self, offset: int) -> Iterator[bytes]:
        """Uncompressed bytes of the range at ``offset``, then those of the following ranges."""
        while offset < self.size:
            n = self.block_size(offset) if self.compressed else self.range_bytes
            data = self._at(offset, n)
            yield zlib.decompress(data, wbits=31) if self.compressed else data
            offset += n

    def ranges(self) -> Iterator[int]:
        offset = 0
        while offset < self.size:
            yield offset
            offset += self.block_size(offset) if self.compressed else self.range_bytes

    def bases(self, offset: int, skip: int, n: int) -> bytes:
        """Up to ``n`` bases of one record from byte ``skip`` of the range at ``offset`` on."""
        found, have, line_start = [], 0, False
        for piece in self.pieces(offset):
            data = np.frombuffer(piece, np.uint8)[skip:]
            skip = 0
            before = np.append(line_start, data[:-1] == _NEWLINE)[: len(data)]
            next_record = np.flatnonzero((data == _OPENS) & before)
            if len(next_record):
                data = data[: next_record[0]]
            line_start = bool(len(data)) and data[-1] == _NEWLINE
            found.append(data[~np.isin(data, _SPACES)])
            have += len(found[-1])
            if have >= n or len(next_record):
                break
        return np.concatenate([np.zeros(0, np.uint8), *found])[:n].tobytes()


def _counted(file: GenomeFile, at: int, previous: int | None) -> tuple[bool | None, int, list[tuple[str | None, int, int]]]:
    """Of the range at ``at``: whether it ends inside a header (None: as it began), the bases before its first line, and the sequences
    that begin in it as (name, or None for the record before; byte; bases). ``previous`` is the range before."""
    pieces = file.pieces(at)
    data = next(pieces)
    raw = np.frombuffer(data, np.uint8)
    lines = np.flatnonzero(raw == _NEWLINE) + 1
    ends_line = bool(len(lines)) and lines[-1] == len(raw)
    lines = lines[lines < len(raw)]
    if len(raw) and raw[0] == _OPENS and (previous is None or next(file.pieces(previous))[-1:] == b"\n"):
        lines = np.append(0, lines)
    elif previous is None:
        lines = np.append(0, lines)
    total = np.concatenate([[0], np.cumsum(~np.isin(raw, _SPACES))])
    if not len(lines):
        return (False if ends_line else None), int(total[-1]), []
    first, headers = int(lines[0]), lines[raw[lines] == _OPENS].tolist() if len(raw) else []
    parts: list[tuple[str | None, int, int]] = []
    ends = [*headers, len(raw)]
    if ends[0] > first:
        parts.append((None, first, int(total[ends[0]] - total[first])))
    for header, end in zip(headers, ends[1:], strict=True):
        line = data[header + 1 :]
        while (stop := line.find(b"\n")) < 0 and (more := next(pieces, None)) is not None:  # the name may go on in the next range
            line += more
        name = line[: stop if stop >= 0 else None].decode().split(maxsplit=1)
        begin = min(header + 2 + (stop if stop >= 0 else len(line)), end)
        parts.append((name[0] if name else "", begin, int(total[end] - total[begin])))
    return bool(len(raw)) and raw[lines[-1]] == _OPENS and not ends_line, int(total[first]), parts


def build_index(spark: SparkSession, path: str | DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Index of all records below ``path`` (or of the files in a column ``file``): bases ``lo`` to ``hi`` of ``chr`` begin at byte ``skip`` of the range ``at``."""
    ship(spark)
    files = path.select("file") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    at_once = 1 << 16

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(uri: str, held: list[int], before: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uri] * len(held), pa.string()), pa.array(held, pa.int64()), pa.array(before, pa.int64())], names=["file", "at", "previous"])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, before, last = [], [], None
                for at in GenomeFile(uri, range_bytes).ranges():
                    held.append(at), before.append(last)
                    last = at
                    if len(held) == at_once:
                        yield made(uri, held, before)
                        held, before = [], []
                yield made(uri, held, before)

    part_type = pa.list_(pa.struct([("name", pa.string()), ("skip", pa.int64()), ("n", pa.int64())]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            rows = []
            for uri, at, previous in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != name:
                    name, opened = uri, GenomeFile(uri, range_bytes)
                rows.append(_counted(opened, at, previous))
            parts = [[{"name": p[0], "skip": p[1], "n": p[2]} for p in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()), pa.array(parts, part_type)],
                names=["file", "at", "in_header", "lead", "parts"],
            )

    ranges = files.mapInArrow(ranged, "file string, at bigint, previous bigint")
    # Neighbouring ranges of a file stay together; a file spreads over tasks.
    spread = ranges.repartition("file", F.expr(f"at div {range_bytes * 128}")).sortWithinPartitions("file", "at")
    found = spread.mapInArrow(counted, "file string, at bigint, in_header boolean, lead bigint, parts array<struct<name: string, skip: bigint, n: bigint>>")
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last("in_header", ignorenulls=True).over(earlier), F.lit(False))
    lead = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("skip"), F.when(inside, 0).otherwise(F.col("lead")).cast("bigint").alias("n"))
    parts = found.select("file", "at", lead.alias("lead"), "parts").select("file", "at", F.posexplode(F.concat(F.array("lead"), "parts")).alias("i", "p"))
    upto = Window.partitionBy("file").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.select("file", "at", "i", "p.*", F.sum("p.n").over(upto).alias("upto"))
    opened = F.when(F.col("name").isNotNull(), F.struct("name", (F.col("upto") - F.col("n")).alias("before")))
    placed = placed.withColumn("record", F.last(opened, ignorenulls=True).over(upto)).where("n > 0 and record is not null")
    hi = F.col("upto") - F.col("record.before")
    return placed.select("file", "at", "skip", F.col("record.name").alias("chr"), (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def fetch(windows: DataFrame, index: DataFrame, longest: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of ``windows`` (``chr``, ``start``, ``end``; at most ``longest`` bases) with their forward bases ``seq``; NULL where no record has the first base.

    A window that runs over the end of its record is cut there.
    """
    ship(windows.sparkSession)
    rows = windows.withColumn("_tile", F.shiftright("start", TILE_BITS))
    tiles = F.explode(F.sequence(F.shiftright("lo", TILE_BITS), F.shiftright(F.col("hi") - 1, TILE_BITS)))
    held = broadcast_if_small(index.select(*[F.col(c).alias(f"_{c}") for c in ("file", "at", "skip", "lo", "hi", "chr")], tiles.alias("_index_tile")))
    own = (F.col("chr") == F.col("_chr")) & (F.col("_tile") == F.col("_index_tile")) & (F.col("start") >= F.col("_lo")) & (F.col("start") < F.col("_hi"))
    kept = windows.columns
    # What one task reads again and again is read once: windows of a range stand together. They are no more than its bases, by strand and method.
    located = rows.join(held, own, "left").select(*kept, "_file", "_at", "_skip", "_lo", "_hi")
    near = located.repartition("_file", "_at").sortWithinPartitions("_file", "_at", "_lo")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name, held, bases = None, None, None, b""
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("start", "end") or i >= len(kept)}
            found: list[str | None] = []
            for k, uri in enumerate(column["_file"]):
                if uri is None:
                    found.append(None)
                    continue
                if uri != name:
                    name, opened, held = uri, GenomeFile(uri, range_bytes), None
                here, lo = (column["_at"][k], column["_skip"][k]), column["_lo"][k]
                if here != held:
                    held, bases = here, opened.bases(*here, column["_hi"][k] - lo + longest - 1)
                found.append(bases[column["start"][k] - lo : column["end"][k] - lo].decode())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(found, pa.string())], names=[*kept, "seq"])

    schema = StructType([*windows.schema.fields, StructField("seq", StringType())])
    return near.mapInArrow(read, schema)


def block(data: bytes) -> bytes:
    """One compressed block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(_BLOCK_HEADER) + 2 + len(body) + 8
    return _BLOCK_HEADER + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_blocked(lines: DataFrame, folder: str) -> DataFrame:
    """Text lines (``value``), a partition to a block-compressed file below ``folder``; returns the files, as Parquet below ``folder`` lists them.

    A file's name holds the task attempt, and the list holds those of the attempts that ended well: others are never read. The first line
    of a partition must be a header.
    """
    ship(lines.sparkSession)
    uri = _uri(folder)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, top = fs.FileSystem.from_uri(uri)
        system.create_dir(top)
        name, held, blocks = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.fa.gz", b"", 0
        with system.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    held += line.encode() + b"\n"
                    if len(held) >= BLOCK_BYTES:
                        whole = len(held) // BLOCK_BYTES * BLOCK_BYTES
                        for at in range(0, whole, BLOCK_BYTES):
                            out.write(block(held[at : at + BLOCK_BYTES]))
                            blocks += 1
                        held = held[whole:]
            if held:
                out.write(block(held))
                blocks += 1
            out.write(_LAST_BLOCK)
        if blocks:
            yield pa.RecordBatch.from_pydict({"file": [f"{uri}/{name}"], "blocks": [blocks]})

    files = lines.select("value").mapInArrow(written, "file string, blocks bigint")
    files.write.parquet(f"{folder}/_files")
    return lines.sparkSession.read.schema(files.schema).parquet(f"{folder}/_files")
