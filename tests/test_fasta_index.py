"""Indexed FASTA: byte ranges of plain and block-compressed files against the plain text."""

import gzip
import os
import random
import zlib

import pytest
from pyspark.errors import PySparkException

from cutsites import schemas
from cutsites.operators import sequence as S
from cutsites.sources import fasta, fasta_index, sinks

WINDOWS = "chr string, start long, end long, k long"


def blocks_of(text: bytes, n: int) -> bytes:
    return b"".join(fasta_index.block(text[i : i + n]) for i in range(0, len(text), n)) + fasta_index._LAST_BLOCK


def genome_text(rng, names):
    want, text = {}, ""
    for name in names:
        bases = "".join(rng.choice("ACGTNacgt") for _ in range(rng.choice([0, 1, 7, 63, 64, 65, 500, 3000])))
        width = rng.choice([1, 7, 60, 10_000])
        end = rng.choice(["\n", "\r\n", "\n\n"])
        want[name] = bases
        text += f">{name} a longer description {'of it ' * rng.randrange(30)}\n" + end.join(bases[i : i + width] for i in range(0, len(bases), width)) + end
    return want, text


def windows_of(rng, want, n):
    rows = []
    for k in range(n):
        name = rng.choice(list(want) + ["absent"])
        start = rng.randrange(len(want.get(name, "")) + 3)
        rows.append((name, start, start + rng.randrange(1, 41), k))
    return rows


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 16])
def test_windows_equal_the_text(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    want = {}
    for f in range(3):
        part, text = genome_text(rng, [f"f{f}r{r}" for r in range(6)])
        want |= part
        raw = text.rstrip("\n").encode() if f == 0 else text.encode()
        if f == 1:
            (tmp_path / f"g{f}.fa.gz").write_bytes(blocks_of(raw, rng.choice([50, 333, 5000])))
        else:
            (tmp_path / f"g{f}.fa").write_bytes(raw)
    index = fasta_index.build_index(spark, str(tmp_path), range_bytes).cache()
    sizes = {r["chr"]: r["n"] for r in index.groupBy("chr").agg({"hi": "max"}).withColumnRenamed("max(hi)", "n").collect()}
    assert sizes == {c: len(s) for c, s in want.items() if s}
    assert index.where("hi <= lo").count() == 0
    rows = windows_of(rng, want, 400)
    got = {r.k: r.seq for r in fasta_index.fetch(spark.createDataFrame(rows, WINDOWS), index, 40, range_bytes).collect()}
    for name, start, end, k in rows:
        assert got[k] == (want.get(name, "")[start:end] or None), (name, start, end)


def test_a_record_of_one_line_is_read_by_ranges(spark, tmp_path):
    """Ten million bases in one line: the bytes that no window needs may be destroyed after the index was made."""
    rng = random.Random(1)
    unit = "".join(rng.choice("ACGT") for _ in range(1 << 16))
    bases = unit * 160
    path = tmp_path / "one.fa"
    path.write_text(f">chrA whole\n{bases}\n")
    index = fasta_index.build_index(spark, str(tmp_path)).cache()
    assert index.count() in (161, 160) and index.agg({"hi": "max"}).first()[0] == len(bases)
    wanted = [5, 3_000_000, 9_999_990]
    keep = [(p // 65536 * 65536 - 64, p // 65536 * 65536 + 2 * 65536) for p in wanted]
    raw = bytearray(path.read_bytes())
    for at in range(0, len(raw), 1000):
        if not any(lo <= at and at + 1000 <= hi for lo, hi in keep) and not any(lo < at + 1000 and at < hi for lo, hi in keep):
            raw[at : at + 1000] = b"!" * len(raw[at : at + 1000])
    assert raw.count(b"!") > 9_000_000
    path.write_bytes(bytes(raw))
    rows = [("chrA", p, p + 30, k) for k, p in enumerate(wanted)]
    got = {r.k: r.seq for r in fasta_index.fetch(spark.createDataFrame(rows, WINDOWS), index, 30).collect()}
    assert got == {k: bases[p : p + 30] for k, p in enumerate(wanted)}
    opened = fasta_index.GenomeFile(str(path))
    assert opened.bases(65536 * 40, 0, 100) and opened.bytes_read <= 3 * 65536


def test_blocks_are_gzip_members(spark, tmp_path):
    chunks = spark.createDataFrame([("c2", i, "ACGT" * 8) for i in range(5000)] + [("c1", 0, "TTTT")], schemas.GENOME_CHUNKS)
    files = fasta_index.write_blocked(fasta.genome_lines(chunks, 32), str(tmp_path / "z"))
    listed = [r.file.removeprefix("file://") for r in files.collect()]
    text = "".join(gzip.decompress(open(f, "rb").read()).decode() for f in sorted(listed))
    assert text == ">c1\nTTTT\n>c2\n" + ("ACGT" * 8 + "\n") * 5000
    index = fasta_index.build_index(spark, files)
    assert {(r["chr"], r["n"]) for r in index.groupBy("chr").agg({"hi": "max"}).withColumnRenamed("max(hi)", "n").collect()} == {("c1", 4), ("c2", 160_000)}
    assert index.where("chr = 'c2'").count() >= 3  # several blocks, each read alone


def test_a_file_compressed_in_one_piece_is_rejected(spark, tmp_path):
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(b">c\nACGT\n"))
    with pytest.raises(PySparkException, match="in one piece"):
        fasta_index.build_index(spark, str(tmp_path)).collect()


def test_upstream_windows_through_the_index(spark, tmp_path):
    rng = random.Random(4)
    bases = "".join(rng.choice("ACGTacgt") for _ in range(997))
    chunks = spark.createDataFrame([("c", i // 8, bases[i : i + 8]) for i in range(0, len(bases), 8)], schemas.GENOME_CHUNKS)
    sinks.write_genome(chunks, str(tmp_path / "g"), 8)
    rows = [("sp", "L1", "c", s, p) for p in (1, 3, 64, 65, 500, 996, 997) for s in "+-"] + [("sp", "L1", "d", "+", 5)]
    sites = spark.createDataFrame(rows, "species string, library_method string, chr string, strand string, end5 long")
    lengths = spark.createDataFrame([("c", 997)], schemas.GENOME_LENGTHS)
    index = fasta_index.build_index(spark, str(tmp_path / "g"), 100)
    columns = ["chr", "strand", "end5", "start", "end", "seq"]
    got = S.upstream_sequence_indexed(sites, index, lengths, 10, 100).select(columns)
    want = S.upstream_sequence(sites, chunks, lengths, 10, 8).select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan text" not in plan  # no scan of the genome text


def test_records_in_parts_over_files(spark, tmp_path):
    chunks = spark.createDataFrame([(c, i, f"{'ACGT'[i % 4]}" * 8) for c in ("c1", "c2") for i in range(100)], schemas.GENOME_CHUNKS).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_genome(chunks, str(tmp_path / "g"), 8, part_chunks=7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(f.endswith(".txt") for f in os.listdir(tmp_path / "g")) > 1
    got = fasta.read_genome_chunks(spark, str(tmp_path / "g"), 8, offsets=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.collect()))
    plan = fasta.genome_lines(chunks, 8, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
