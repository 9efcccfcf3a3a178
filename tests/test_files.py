"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from ravel import adapters as D
from ravel.operators import evaluate as E
from ravel.plans.call import call
from ravel.sources import sequences, svseg, truth, vcf


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta_and_fastq(spark, tmp_path):
    fa = put(tmp_path, "a.fa", ">r1 first\nacgu\nACG\n>r2\nNNAC\n")
    assert {(r.read_id, r.seq, r.read_len) for r in sequences.read_fasta(spark, fa).collect()} == {("r1", "ACGTACG", 7), ("r2", "NNAC", 4)}
    fq = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\n@@@@\n@r2\nAC\n+\n!!\n")
    assert {(r.read_id, r.seq) for r in sequences.read_fastq(spark, fq).collect()} == {("r1", "ACGT"), ("r2", "AC")}


def test_fasta_compressed_and_round_trip(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">r1\nACGT\n>r2\nGG\n")
    reads = sequences.read_fasta(spark, str(tmp_path / "a.fa.gz"))
    sequences.write_fasta(reads, str(tmp_path / "out"))
    assert {(r.read_id, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == {("r1", "ACGT"), ("r2", "GG")}


def test_svseg_round_trip(spark, tmp_path, sf_dir):
    seg = D.planted_segments(D.table(spark, sf_dir, "orders"))
    svseg.write_svseg(seg, str(tmp_path / "s"))
    back = svseg.read_svseg(spark, str(tmp_path / "s"))
    assert back.count() == seg.count() and back.exceptAll(seg).count() == 0


def test_fai_truth_and_genotypes(spark, tmp_path):
    fai = put(tmp_path, "a.fai", "chr1\t1000\t6\t60\t61\nchr2\t500\t7\t60\t61\n")
    assert [tuple(r) for r in sequences.read_fai(spark, fai).orderBy("ord").select("chr", "length").collect()] == [("chr1", 1000), ("chr2", 500)]
    bed = put(tmp_path, "t.bed", "chr2\t10\t60\tdeletion\tNone\t0\nchr1\t5\t9\tinsertion\tACGT\t0\nchr1\t100\t200\treciprocal translocation\th1:chr3:900:forward:reverse\t0\n")
    got = {tuple(r) for r in truth.explode_truth(truth.read_bed(spark, bed)).collect()}
    assert got == {
        ("DEL", "chr2", 10, 60, 51, None, None, None), ("INS", "chr1", 5, None, 4, None, None, None),
        ("BND", "chr1", 100, None, None, "chr3", 900, "N[["), ("BND", "chr1", 100, None, None, "chr3", 1000, "[[N"), ("BND", "chr1", 200, None, None, "chr3", 900, "N]]"), ("BND", "chr1", 200, None, None, "chr3", 1000, "]]N"),
    }
    gt = put(tmp_path, "g.bed", "chr1\t1\t2\t100\t100.0\nchr2\t1\t2\t100\t50.0\nchr3\t1\t2\t100\t20.0\n")
    assert {tuple(r) for r in truth.read_genotypes(spark, gt).collect()} == {("chr1", "hom"), ("chr2", "het"), ("chr3", "None")}


def test_fasta_keeps_records_of_any_length(spark, tmp_path):
    fa = put(tmp_path, "long.fa", ">c\n" + "ACGTACGTAC" * 150_000 + "\n")
    assert [r.n for r in sequences.read_fasta(spark, fa).selectExpr("length(seq) as n").collect()] == [1_500_000]
    assert [r.read_len for r in sequences.read_fasta(spark, fa, most=7).collect()] == [7]


def test_header_has_the_contigs_in_the_order_of_the_fai(spark, tmp_path):
    names = [f"chr{i}" for i in (*range(1, 13), "X", "M")]
    fai = put(tmp_path, "a.fai", "".join(f"{n}\t{100 + i}\t{6 + i}\t60\t61\n" for i, n in enumerate(names)))
    lines = [r.line for r in vcf.header(sequences.read_fai(spark, fai)).orderBy("line_no").collect()]
    assert [x for x in lines if x.startswith("##contig")] == [f"##contig=<ID={n},length={100 + i}>" for i, n in enumerate(names)]


def test_records_with_allele_sequences(spark, tmp_path, sf_dir):
    calls = call(D.planted_segments(D.table(spark, sf_dir, "orders")))
    dels = F.col("sv_type") == "DEL"
    vcf.write(calls, D.contigs_view(spark), str(tmp_path / "v"), ref=F.when(dels, F.lit("ACG")), alt=F.when(dels, F.lit("A")))
    got = {(r.ID.split(".")[-2], r.REF, r.ALT) for r in vcf.read(spark, str(tmp_path / "v")).collect()}
    assert {x for x in got if x[0] == "DEL"} == {("DEL", "ACG", "A")} and all(r == "N" for t, r, _ in got if t != "DEL") and ("INS", "N", "<INS>") in got


def test_vcf_written_and_evaluated(spark, tmp_path, sf_dir):
    orders = D.table(spark, sf_dir, "orders")
    calls = call(D.planted_segments(orders))
    vcf.write(calls, D.contigs_view(spark), str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and sum(x.startswith("#CHROM") for x in lines) == 1 and sum(x.startswith("##contig") for x in lines) == 3
    body = vcf.read(spark, str(tmp_path / "v"))
    assert body.count() == calls.count()
    r = {(x.sv_type, x.side): x.rate_1 for x in E.compare({"own": body}, D.truth_view(orders), D.genotype_view(spark)).collect()}
    assert r[("DEL", "recall")] == 1.0 and r[("INV", "recall")] == 1.0 and r[("DEL", "precision")] == 1.0


def test_sequences_of_sites_and_reads(spark):
    ref = spark.createDataFrame([("c", "ACGTACGT")], "chr string, seq string")
    sites = spark.createDataFrame([("c", 0, 3), ("c", 3, 2)], "chr string, p long, n long")
    assert {r.s for r in sequences.bases_at(sites, ref, "p", "n", "s").collect()} == {"ACG", "GT"}
    reads = spark.createDataFrame([("r", "AACCGGTTAC")], "read_id string, seq string")
    rows = spark.createDataFrame([("r", 2, 4, "+"), ("r", 2, 4, "-")], "q_read string, q_start long, q_len long, q_strand string")
    assert {r.ins_seq for r in sequences.inserted_sequence(rows, reads).collect()} == {"CCGG", "AACC"}


@pytest.mark.parametrize("split", [64, 150, 1000, 1 << 20])
def test_records_lie_across_splits(spark, tmp_path, split):
    """Pieces of a FASTA file put together are its records, wherever the splits fall."""
    import random

    r = random.Random(split)
    letters = lambda n: "".join(r.choice("ACGTacgtuN") for _ in range(n))
    want, lines = {}, ["", "stray"]
    for i, n in enumerate((1, 700, 0, 61, 60, 3000, 5)):
        s = letters(n)
        want[f"c{i}"] = s.upper().replace("U", "T")
        lines += [f">c{i} some words"] + [s[j : j + 60] for j in range(0, n, 60)]
    (tmp_path / "ref.fa").write_text("\n".join(lines) + "\n")
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = sequences.read_reference(spark, str(tmp_path / "ref.fa")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {}
    for x in sorted(rows, key=lambda x: (x.chr, x.at)):
        assert x.at == len(got.get(x.chr, "")) and len(x.seq) <= 60
        got[x.chr] = got.get(x.chr, "") + x.seq
    assert got == {k: v for k, v in want.items() if v}


def test_reads_align_to_a_reference_in_pieces(spark, tmp_path):
    import random

    from ravel.operators.align import align

    r = random.Random(3)
    g = "".join(r.choice("ACGT") for _ in range(6000))
    (tmp_path / "ref.fa").write_text(">chrA x\n" + "\n".join(g[i : i + 70] for i in range(0, len(g), 70)) + "\n")
    reads = spark.createDataFrame([("r", g[1000:4000])], "read_id string, seq string")
    (row,) = align(reads, sequences.read_reference(spark, str(tmp_path / "ref.fa"))).collect()
    assert (row.chr, row.strand, row.rd_l, row.rd_r, row.rf_l, row.rf_r) == ("chrA", "+", 0, 2999, 1001, 4000)
