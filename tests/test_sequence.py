"""Sequence slices, identities and FASTA chunks."""

import random

from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.operators import sequence as S
from cutsites.sources import fasta

COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def genome(spark, bases, n, contig="c"):
    rows = [(contig, i // n, bases[i : i + n]) for i in range(0, len(bases), n)]
    return spark.createDataFrame(rows, schemas.GENOME_CHUNKS)


def test_upstream_sequence_both_strands_and_clipped(spark):
    rng = random.Random(1)
    bases = "".join(rng.choice("ACGTacgt") for _ in range(101))
    sites = [(p, s) for p in (1, 3, 8, 9, 50, 95, 101) for s in "+-"]
    df = spark.createDataFrame([("sp", "L1", "c", s, p) for p, s in sites], "species string, library_method string, chr string, strand string, end5 long")
    lengths = spark.createDataFrame([("c", 101)], schemas.GENOME_LENGTHS)
    for n, chunk_len in ((10, 8), (3, 8), (20, 8)):
        got = {(r.end5, r.strand): r.seq for r in S.upstream_sequence(df, genome(spark, bases, chunk_len), lengths, n, chunk_len).collect()}
        for p, s in sites:
            lo, hi = (max(0, p - 1 - n), p) if s == "+" else (p - 1, min(101, p + n))
            want = bases[lo:hi] if s == "+" else bases[lo:hi].translate(COMPLEMENT)[::-1]
            assert got[(p, s)] == want, (n, p, s)


def test_mispriming_filter_equals_stepwise(spark):
    rng = random.Random(2)
    bases = "".join(rng.choice("AACCG") for _ in range(600))
    rows = [("sp", m, "c", s, p) for p in range(1, 601, 3) for s in "+-" for m in ("TA", "TC", "ZZ")]
    df = spark.createDataFrame(rows, "species string, library_method string, chr string, strand string, end5 long")
    lengths = spark.createDataFrame([("c", 600)], schemas.GENOME_LENGTHS)
    oligos = [("TA", 4, "AACC"), ("TA", 10, "A" * 10), ("TC", 4, "CCAA"), ("TC", 10, "AC" * 5)]
    chunks = genome(spark, bases, 16)
    limits = {4: 4, 10: 5}
    for flank in (0, -1):
        kept = S.mispriming_filter(df, chunks, lengths, spark.createDataFrame(oligos, schemas.OLIGOS), limits, flank, 16)
        want = set()
        for _, m, _, s, p in rows:
            ok = m != "ZZ"
            for method, n, oligo in oligos:
                if method != m:
                    continue
                lo, hi = (max(0, p - 1 - n - flank), p) if s == "+" else (p - 1, min(600, p + n + flank))
                seq = bases[lo:hi] if s == "+" else bases[lo:hi].translate(COMPLEMENT)[::-1]
                ok = ok and len(seq) >= n and sum(a == b for a, b in zip(oligo, seq)) < limits[n]
            if ok:
                want.add((m, s, p))
        assert {(r.library_method, r.strand, r.end5) for r in kept.collect()} == want
        with_seq = S.upstream_sequence(df, chunks, lengths, 10 + flank, 16)
        ids = S.oligo_identities(with_seq, spark.createDataFrame(oligos, schemas.OLIGOS), flank)
        passed = [
            {(r.library_method, r.strand, r.end5) for r in S.below_limit(ids, n, m).collect()} for n, m in limits.items()
        ]
        assert passed[0] & passed[1] == want
        assert {r.oligo_len for r in S.truncated(ids).where("n_truncated > 0").collect()} == {4, 10}


def test_fasta_over_many_splits(spark, tmp_path):
    """Records, wrapped and unwrapped lines and several files, cut into tiny text splits."""
    rng = random.Random(5)
    want, texts = {}, []
    for f in range(2):
        text = ""
        for r in range(4):
            bases = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 59, 60, 900, 3000])))
            width = rng.choice([7, 60, 10_000])
            want[f"f{f}r{r}"] = bases
            text += f">f{f}r{r} some description\n" + "\n".join(bases[i : i + width] for i in range(0, len(bases), width)) + "\n"
        texts.append(text)
        (tmp_path / f"g{f}.fa").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name in old:
            spark.conf.set(name, "300")
        chunks = fasta.read_genome_chunks(spark, str(tmp_path), 64)
        got = {}
        for r in chunks.orderBy("chr", "chunk").collect():
            assert len(r.seq) == 64 or r.chunk == (len(want[r.chr]) - 1) // 64
            got[r.chr] = got.get(r.chr, "") + r.seq
        assert got == want
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_every_oligo_of_a_length_counts(spark):
    """A second oligo of the same length must not hide the first one."""
    bases = "TTTTACGATTTT"
    site = spark.createDataFrame([("sp", "TA", "chr1", "+", 8)], "species string, library_method string, chr string, strand string, end5 long")
    lengths = spark.createDataFrame([("chr1", 12)], schemas.GENOME_LENGTHS)
    chunks = genome(spark, bases, 4, "chr1")
    with_seq = S.upstream_sequence(site, chunks, lengths, 4, 4)
    assert [r.seq for r in with_seq.collect()] == ["TACGA"]  # the oligo is compared with TACG, before the site
    for oligos, kept in (
        ([("TA", 4, "TACG")], 0), ([("TA", 4, "TACG"), ("TA", 4, "TTTT")], 0), ([("TA", 4, "TTTT"), ("TA", 4, "TACG")], 0), ([("TA", 4, "GGGG"), ("TA", 4, "CCCC")], 1),
    ):
        oligo = spark.createDataFrame(oligos, schemas.OLIGOS)
        got = S.mispriming_filter(site, chunks, lengths, oligo, {4: 4}, 0, 4)
        ids = S.oligo_identities(with_seq, oligo, 0)
        assert got.count() == kept == int(S.below_limit(ids, 4, 4).count() == len(oligos))
