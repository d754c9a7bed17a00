"""Readers, writers, interval operators and scalar functions on small files."""

import pytest
from locusframe.functions import bases as B
from locusframe.operators import coding, intervals, merge
from locusframe.sinks import text as out
from locusframe.sources import text as src
from locusframe.streaming.windows import windowed_values
from pyspark.sql import functions as F

GENO = "#CHROM\tPOS\ts1\ts2\nchr1\t1\tA/A\tA/C\nchr1\t7\tN/N\tG|T\n# comment\nchr2\t3\tC/C\tT/T\n"
VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=100>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t5\t.\tA\tC\t50\tPASS\tDP=9;AF=0.5\tGT:DP\t0/1:10\t1|1:3
chr1\t8\t.\tAC\tA,ACT\t.\tPASS\tDP=4\tGT:DP\t1/2:20\t./.:.
chr1\t9\t.\tG\t.\t3\tq10\tDP=4\tGT:DP\t0/0:9\t0/0:8
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    return write


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_geno_round_trip(spark, put):
    g = src.read_geno(spark, put("a.geno", GENO))
    c = src.geno_calls(g)
    assert c.count() == 12 and rows(c.where("scaffold = 'chr1' and position = 7"), "sample", "hap", "allele") == [("s1", 0, None), ("s1", 1, None), ("s2", 0, 2), ("s2", 1, 3)]
    lines = [r.line for r in out.geno_lines(c).orderBy("ord").collect()]
    assert lines == ["chr1\t1\tA/A\tA/C", "chr1\t7\tN/N\tG/T", "chr2\t3\tC/C\tT/T"]
    assert [r.line for r in out.geno_lines(c, "diplo").orderBy("ord").collect()] == ["chr1\t1\tA\tM", "chr1\t7\tN\tK", "chr2\t3\tC\tT"]
    one_of = spark.createDataFrame([("s1", 1), ("s2", 1)], "sample string, ploidy int")
    assert rows(src.geno_calls(g, one_of).where("position = 1"), "sample", "allele") == [("s1", 0), ("s2", None)]


def test_lines_are_written_in_order(spark, put, tmp_path):
    c = src.geno_calls(src.read_geno(spark, put("a.geno", GENO)))
    out.write_lines(out.geno_lines(c), str(tmp_path / "o"), "#CHROM\tPOS\ts1\ts2")
    back = src.geno_calls(src.read_geno(spark, str(tmp_path / "o")))
    assert rows(back.na.fill(-1), *back.columns) == rows(c.na.fill(-1), *c.columns)
    out.write_table(c.groupBy("scaffold").agg((F.count("*") / 7).alias("x")), str(tmp_path / "t"), ["scaffold"], "\t")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2


def test_vcf(spark, put):
    v = src.read_vcf(spark, put("a.vcf", VCF))
    assert src.vcf_header(spark, put("a.vcf", VCF)) == (["s1", "s2"], [("chr1", 100)])
    assert rows(v.select("pos", src.site_type().alias("t")), "pos", "t") == [(5, "SNP"), (8, "INDEL"), (9, "MONO")]
    assert rows(src.filter_vcf(v, 20), "pos") == [(5,), (8,)] and rows(src.filter_vcf(v, None, 1), "pos") == [(5,), (9,)]
    assert rows(src.vcf_calls(v), "position", "sample", "gt") == [(5, "s1", "A/C"), (5, "s2", "C|C"), (8, "s1", "A/ACT"), (8, "s2", "N/N"), (9, "s1", "G/G"), (9, "s2", "G/G")]
    assert rows(src.vcf_calls(v, [{"flag": "DP", "min": 5, "gt_types": ["HomAlt"]}]).where("position = 5"), "gt") == [("A/C",), ("N|N",)]
    assert rows(src.vcf_calls(v, skip_indels=True).where("position = 8"), "gt") == [("N/N",), ("N/N",)]
    assert rows(src.vcf_field(v, "DP"), "position", "value")[0] == (5, "10") and v.first().info["AF"] == "0.5"
    assert rows(src.expand_multi(v.where("pos = 8")), "pos", "ref") == [(8, "A"), (9, "C")]
    assert one(spark, src.simplify_alt(F.lit("ACGT"), F.lit("2M1D1I1M"))) == "AC-T"


def test_sequences(spark, put):
    f = src.read_fasta(spark, put("a.fa", ">one desc\nACgt\nNN\n>two\nTTT\n"), upper=True)
    assert rows(f, "name", "seq") == [("one", "ACGTNN"), ("two", "TTT")]
    assert [r.line for r in out.fasta(f, 4, gap=True).orderBy("ord").collect()] == [">one\nACGT\n--", ">two\nTTT"]
    p = src.read_phylip(spark, put("a.phy", " 2 6\na ACG\nb TTT\n\nAAA\nCCC\n 1 2\nz GG\n"))
    assert rows(p, "alignment", "name", "seq") == [(0, "a", "ACGAAA"), (0, "b", "TTTCCC"), (1, "z", "GG")]
    assert [r.line for r in out.phylip(f).orderBy("ord").collect()][0] == " 2 6"


def test_annotation_and_small_tables(spark, put):
    gff = "##gff\nc1\tx\tmRNA\t1\t20\t.\t-\t.\tID=m1;Name=z\nc1\tx\tCDS\t12\t17\t.\t-\t0\tParent=m1\nc1\tx\tCDS\t1\t3\t.\t-\t0\tParent=m1\n"
    g = src.read_genes(spark, put("a.gff", gff))
    assert rows(coding.coding_positions(g), "codon", "place", "position") == [(0, 0, 17), (0, 1, 16), (0, 2, 15), (1, 0, 14), (1, 1, 13), (1, 2, 12), (2, 0, 3), (2, 1, 2), (2, 2, 1)]
    gtf = 'c1\tx\ttranscript\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t1";\nc1\tx\tCDS\t2\t4\t.\t+\t0\ttranscript_id "t1";\n'
    assert rows(src.read_genes(spark, put("a.gtf", gtf), "gtf"), "mrna", "strand") == [("t1", "+")]
    assert rows(src.read_fai(spark, put("a.fai", "c1\t100\t5\t60\t61\n")), "scaffold", "length") == [("c1", 100)]
    assert rows(src.read_pops(spark, put("p", "s1 a\ns2 b\n"), {"c": ["s1"]}), "sample", "pop") == [("s1", "a"), ("s1", "c"), ("s2", "b")]
    assert rows(src.read_windows(spark, put("w", "c 1 5 n\nc 6 9\n")), "wname", "start", "end") == [("NA", 6, 9), ("n", 1, 5)]
    agp = "n1 1 10 1 W s1 1 10 +\nn1 11 20 2 N 10 x x x\n"
    assert rows(src.read_transfers(spark, put("agp", agp)), "new_scaf", "scaf", "start", "strand") == [("n1", "s1", 1, "+")]
    assert rows(src.read_transfers(spark, put("tr", "n1 1 10 s1 1 10 -\n")), "new_scaf", "scaf", "strand") == [("n1", "s1", "-")]
    r = spark.createDataFrame([("c:9-3:+",), ("c:5",), ("c",)], "r string").select(src.parse_region(F.col("r")).alias("x")).select("x.*")
    assert sorted(map(tuple, r.na.fill(-1).collect())) == [("c", -1, -1, "+"), ("c", 3, 9, "-"), ("c", 5, -1, "+")]
    assert rows(src.read_ploidy(spark, put("pl", "s1 2\n")), "sample", "ploidy") == [("s1", 2)]


def test_maf(spark, put):
    maf = "##maf\na score=1\ns ref.c1 0 4 + 10 AC-GT\ns alt.x 3 5 + 9 ATCGT\n\na score=2\ns ref.c1 0 2 - 10 AC\ns alt.x 1 2 + 9 GG\n"
    c = src.maf_calls(src.read_maf(spark, put("m", maf)), "ref", min_seqs=2)
    assert rows(c.where("sample = 'alt'"), "position", "base") == [(1, "A"), (2, "T"), (3, "G"), (4, "T"), (9, "C"), (10, "C")]


def test_converters(spark, put):
    c = src.geno_calls(src.read_geno(spark, put("a.geno", GENO)))
    assert [r.line for r in out.vcf_lines(c).orderBy("ord").collect()][0].split("\t")[3:5] + [r.line for r in out.vcf_lines(c).orderBy("ord").collect()][0].split("\t")[9:] == ["A", "C", "0/0", "0/1"]
    geno, snp = out.eigenstrat(c)
    assert [r.line for r in geno.orderBy("ord").collect()] == ["21", "91", "20"] and snp.count() == 3
    ped, mp = out.plink(c)
    assert [r.line for r in ped.orderBy("ord").collect()] == ["s1 s1 0 0 0 -9 A A 0 0 C C", "s2 s2 0 0 0 -9 A C G T T T"] and mp.count() == 3
    assert rows(out.sample_sequences(c), "name", "seq")[0] == ("s1_A", "ANC")
    d = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.25), (2, 2, None)], "s1 long, s2 long, dist double")
    assert [r.line for r in out.distance_matrix(d, [], "phylip").orderBy("s1").collect()] == ["1 0.0 0.25", "2 0.25 nan"]


def test_intervals(spark):
    i = spark.createDataFrame([("c", 1, 5), ("c", 5, 9), ("c", 10, 12), ("d", 1, 2)], "chrom string, start long, end long")
    assert rows(intervals.reduce_intervals(i), "chrom", "start", "end") == [("c", 1, 9), ("c", 10, 12), ("d", 1, 2)]
    t = spark.createDataFrame([("n", 101, 110, "s", 11, 20, "+"), ("m", 101, 110, "z", 11, 20, "-")], "new_scaf string, new_start long, new_end long, scaf string, start long, end long, strand string")
    r = spark.createDataFrame([(1, "s", 13, 13), (2, "z", 13, 13), (3, "z", 13, 15), (4, "s", 5, 13), (5, "q", 1, 2)], "id long, scaf string, start long, end long")
    got = {x.id: (x.new_start, x.new_end, x.status) for x in intervals.liftover(r, t, 5).collect()}
    assert got == {1: (103, 103, "OK"), 2: (108, 108, "OK"), 3: (106, 108, "OK"), 4: (None, None, "BROKEN"), 5: (None, None, "MISSING")}
    p = spark.createDataFrame([("n", 3, 5, "s", 1, 3, "+"), ("n", 8, 9, "s", 1, 2, "-")], t.schema)
    s = spark.createDataFrame([("s", "ACG")], "name string, seq string")
    assert intervals.assemble(p, s).first().sequence == "NNACGNNGT"


def test_merge(spark):
    t = [spark.createDataFrame([("c", p, f"{k}{p}") for p in ps], "scaffold string, position long, gt string") for k, ps in (("x", (1, 2, 3)), ("y", (2, 3, 4)), ("z", (3, 5)))]
    assert rows(merge.merge_sites(t), "position", "gt_0") == [(3, "x3")]
    assert rows(merge.merge_sites(t, "union", 2), "position", "gt_2") == [(2, "N"), (3, "z3")]
    n = spark.createDataFrame([("c", 6)], "scaffold string, length long")
    assert merge.merge_sites(t, "all", lengths=n).count() == 6 and merge.merge_sites(t, silent=(1, 2)).columns == ["scaffold", "position", "gt_0"]
    d = t[0].withColumn("o", F.lit(2)).unionByName(t[0].withColumn("gt", F.lit("first")).withColumn("o", F.lit(1)))
    assert {r.gt for r in merge.dedup_sites(d, "o").collect()} == {"first"}


def test_bases(spark):
    assert one(spark, B.reverse_complement(B.reverse_complement(F.lit("ACGTRYKMSWN")))) == "ACGTRYKMSWN"
    assert one(spark, B.expand_ambiguity(F.lit("RAY"))) == ["AAC", "AAT", "GAC", "GAT"]
    assert one(spark, B.translate(F.lit("ATGGCTTAANNN"))) == "MA_X" and one(spark, B.count_stops(F.lit("TAAATGTAA"))) == 1
    for codon, want in (("ATG", (2, 0, 2)), ("GCT", (0, 0, 4)), ("CTA", (2, 0, 4))):
        s = F.array(*[F.lit(x) for x in codon])
        got = tuple(one(spark, B.degeneracy(s, i)) for i in range(3))
        assert got[1:] == want[1:] or codon == "ATG"
    sets = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, B.syn_non(sets("G", "C", "AT"))) == "syn" and one(spark, B.syn_non(sets("AG", "C", "T"))) == "non" and one(spark, B.syn_non(sets("AG", "CT", "T"))) is None
    g = F.array(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))
    assert one(spark, B.as_phased(g, "|")) == "A|G" and one(spark, B.as_count(g, F.lit(2))) == 1 and one(spark, B.as_coded(g, F.array(F.lit(2).cast("bigint"), F.lit(0).cast("bigint")))) == "1/0"
    assert one(spark, B.force_ploidy(g, 1)) == [None] and one(spark, B.force_ploidy(g, 3)) == [0, 2, None]
    assert one(spark, B.haploid_letter(F.lit("R"))) == "N" and one(spark, B.diploid_alleles(F.lit("R"))) == "AG"
    assert one(spark, B.random_allele(g, "id")) in (0, 2)


def test_coding_sites(spark):
    genes = spark.createDataFrame([("c", "m", 1, 6, "+", [(1, 6)])], "scaffold string, mrna string, start long, end long, strand string, cds array<struct<start:long,end:long>>")
    a = spark.createDataFrame([("c", 1, "G"), ("c", 2, "C"), ("c", 3, "AT"), ("c", 4, "A"), ("c", 5, "AC"), ("c", 6, "G")], "scaffold string, position long, bases string")
    got = {r.position: (r.codon_position, r.syn_non, r.degeneracy) for r in coding.coding_sites(genes, a).collect()}
    assert got[3] == (3, "syn", 4) and got[5][1] == "non" and got[1][0] == 1
    c = spark.createDataFrame([("c", p, 0, 0, 0, v) for p, v in ((1, 0), (2, None), (4, 3))], "scaffold string, position long, sample long, pop long, hap long, allele long")
    assert coding.cds_alignments(genes, c).first().sequence == "ANNTNN"


def test_streaming_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    w = windowed_values(s, "1 day", "12 hours").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    cols = ["start", "event_type", "n"]
    assert rows(spark.table("w"), *cols) == rows(windowed_values(e, "1 day", "12 hours"), *cols)
