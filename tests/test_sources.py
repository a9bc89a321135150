"""Readers and sinks over small files."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.operators import counts as C
from cutsites.profile import PROFILE_MULTI
from cutsites.session import broadcast_if_small, scratch_path
from cutsites.sources import sinks, tables


def test_sheet_paths_and_fragments(spark, tmp_path):
    """Paths resolve from the sheet; all files are read as one table."""
    sheet_file = tmp_path / "sheet.csv"
    sheet_file.write_text(
        "sample,method,sample_rep,sample_type,dataset,species\n"
        "s1,tailing_polyA,rep1,A,run1#note,mouse\n"
        "s2,tailing_polyA,rep2,A,run2,mouse\n"
    )
    for run, sample in (("run1", "s1"), ("run2", "s2")):
        folder = tmp_path / run / "results" / "04.bed"
        folder.mkdir(parents=True)
        (folder / f"{sample}_genome.bed").write_text(f"chr1\t5\t9\tx\t3\t+\t{sample}\nchr1\t5\t9\tcapped\t1\t-\t{sample}\n")
    sheet = tables.read_sample_sheet(spark, str(sheet_file))
    assert [r.exclude for r in sheet.collect()] == [None, None]
    recoded = C.recode_sheet(sheet, PROFILE_MULTI)
    paths = sorted(r.path for r in tables.with_paths(recoded, "/root_dir", "spikeins").collect())
    assert paths == ["/root_dir/run1/results/04.bed/s1_spikeins.bed", "/root_dir/run2/results/04.bed/s2_spikeins.bed"]
    frags = tables.read_sheet_fragments(spark, recoded, str(tmp_path), "genome")
    assert frags.schema == schemas.FRAGMENTS and frags.count() == 4
    with pytest.raises(ValueError, match="s2"):
        bad = sheet.withColumn("dataset", F.when(F.col("sample") != "s2", F.col("dataset")))
        tables.read_sheet_fragments(spark, C.recode_sheet(bad, PROFILE_MULTI), str(tmp_path), "genome")
    counts = C.count_end5(frags, recoded, PROFILE_MULTI)
    assert sorted((r.sample, r.end5, r.count_end5) for r in counts.collect()) == [
        ("mouse|TA|r1|A", 6, 3), ("mouse|TA|r2|A", 6, 3),
    ]


def test_alias_tables(spark, tmp_path):
    four = tmp_path / "four.txt"
    four.write_text("# comment\nchr1\t1\tE1\tG1\nchr2\t2\tE2\t\nchr3_alt\t3\tE3\tG3\nchrUn\t4\tE4\tG4\nchrX\tX\tE5\tG5\n")
    two = tmp_path / "two.tsv"
    two.write_text("G9\tchr9\n")
    one = tmp_path / "one.fai"
    one.write_text("contigA\t100\t7\ncontigB\t50\t9\n")
    alias = tables.without_alternates(tables.read_alias_four(spark, str(four)))
    main = tables.alias_table(tables.main_chromosomes(alias), tables.read_alias_two(spark, str(two)))
    assert sorted(map(tuple, main.collect())) == [("E2", "chr2"), ("G1", "chr1"), ("G5", "chrX"), ("G9", "chr9")]
    assert [r.chr for r in tables.read_contig_names(spark, str(one)).collect()] == ["contigA", "contigB"]
    assert tables.read_genome_lengths(spark, str(one)).first().length == 100


def test_oligos(spark, tmp_path):
    for name, seq in (("oligo_TA_4", "AAAA"), ("oligo_TA_10", "A" * 10)):
        (tmp_path / f"{name}.fa").write_text(f">{name} text\n{seq}\n")
    (tmp_path / "wrapped.fa").write_text(">x_L1_10 text\nACGT\nTTGC\nAA\n\n>x_L1_4\nACGT")
    got = tables.read_oligos(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("L1", 4, "ACGT"), ("L1", 10, "ACGTTTGCAA"), ("TA", 4, "AAAA"), ("TA", 10, "A" * 10)]


COUNTS = "species string, sample string, library_method string, sample_rep string, sample_type string, chr string, strand string, end5 long, count_end5 long"


def test_partitioned_counts_prune(spark):
    """Numeric-looking contigs stay strings and key filters prune folders."""
    rows = [("sp", "s", m, "r1", "A", c, s, p, p) for m in ("L1", "TA") for c in ("1", "X") for s in "+-" for p in (5, 6)]
    df = spark.createDataFrame(rows, COUNTS)
    path = scratch_path(spark, "counts")
    sinks.write_counts(df, path)
    inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
    spark.conf.unset(inference)  # the reader does not depend on it
    back = tables.read_counts_dataset(spark, path)
    spark.conf.set(inference, "false")
    with pytest.raises(AnalysisException):
        sinks.write_counts(df, path)  # nothing is replaced
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)
    some = back.where("chr = '1' and strand = '+' and library_method = 'TA'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert sorted(r.end5 for r in some.collect()) == [5, 6]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 9, "x"), (None, 1, "y"), ("a", 3, "z")], "chrom string, start long, v string")
    bed = scratch_path(spark, "bed")
    sinks.write_bed(df.coalesce(1), bed)
    lines = [r.value for r in spark.read.text(bed).coalesce(1).collect()]
    assert sorted(lines) == sorted(["a\t3\tz", "a\t9\tx", 'b\t2\t', '\t1\ty'])
    ordered = [(r.chrom, r.start) for r in sinks.sorted_by(df, ["chrom", "start"]).collect()]
    assert ordered == [("a", 3), ("a", 9), ("b", 2), (None, 1)]
    split = scratch_path(spark, "split")
    sinks.write_split(df.where("chrom is not null"), split, "chrom", ["start"])
    back = spark.read.schema("start long, v string, chrom string").option("sep", "\t").csv(split)
    assert sorted((r.chrom, r.start, r.v) for r in back.collect()) == [("a", 3, "z"), ("a", 9, "x"), ("b", 2, None)]
    for writer, name in ((sinks.write_report, "report"), (sinks.write_parquet, "parquet")):
        path = scratch_path(spark, name)
        writer(df, path)
        reader = spark.read.schema(df.schema)
        assert (reader.parquet(path) if name == "parquet" else reader.option("header", True).csv(path)).count() == 4
    merged = scratch_path(spark, "merged")
    sinks.write_bed(spark.createDataFrame([("c", 1, 2, "+", "a,b")], schemas.MERGED_BED), merged, ("chr", "start"))
    assert tables.read_merged_bed(spark, merged).first().id == "a,b"


def test_broadcast_only_below_the_bound(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_if_small(spark.range(10), 10))
    assert not hinted(broadcast_if_small(spark.range(11), 10))
