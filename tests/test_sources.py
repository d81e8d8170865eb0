import gzip
import struct

from pyspark.sql import functions as F

from seqloom.sources import binary as B
from seqloom.sources import text as T


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_round_trip(spark, tmp_path):
    df = T.read_fasta(spark, put(tmp_path / "a.fa", ">one x\nACGT\r\nAC\n>two\n\n>three\nG"))
    rows = [(r.name, r.seq) for r in df.orderBy("rowid").collect()]
    assert rows == [("one x", "ACGTAC"), ("two", ""), ("three", "G")]
    T.write_fasta(df, str(tmp_path / "out"), width=3)
    assert {(r.name, r.seq) for r in T.read_fasta(spark, str(tmp_path / "out")).collect()} == set(rows)


def test_fastq_round_trip(spark, tmp_path):
    df = T.read_fastq(spark, put(tmp_path / "a.fq", "@a\nACG\n+\nI!@\n@b\n\n+\n\n@c\nT\n+c\n@\n"))
    rows = [(r.name, r.seq, r.qual) for r in df.orderBy("rowid").collect()]
    assert rows == [("a", "ACG", [40, 0, 31]), ("b", "", []), ("c", "T", [31])]
    T.write_fastq(df, str(tmp_path / "out"), gzip=True)
    assert sorted((r.name, r.seq, r.qual) for r in T.read_fastq(spark, str(tmp_path / "out")).collect()) == rows


def test_bed_and_gff(spark, tmp_path):
    bed = T.read_bed(spark, put(tmp_path / "a.bed", "#c\ntrack x\nc1\t5\t9\nc2\t1\t2\tn\t3.5\t-\tmore\tyet\n"))
    assert [(r.chrom, r.start, r.end, r.name, r.extra) for r in bed.orderBy("rowid").collect()] == [("c1", 5, 9, None, []), ("c2", 1, 2, "n", ["more", "yet"])]
    gff = T.read_gff(spark, put(tmp_path / "a.gff", "##gff-version 3\nc1\ts\tgene\t5\t9\t.\t+\t.\tID=a;Name=x%20y;ID=b\n##FASTA\n>c1\nc1\ts\tgene\t1\t2\t.\t+\t.\tID=z\n"))
    assert [(r.type, r.start, r.score, r.attributes) for r in gff.collect()] == [("gene", 5, None, {"ID": "b", "Name": "x y"})]


def test_tool_outputs(spark, tmp_path):
    sam = T.read_sam(spark, put(tmp_path / "a.sam", "@SQ\tSN:c1\tLN:50\nr\t99\tc1\t6\t30\t2S3M\t=\t9\t8\tACGTA\tIIIII\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n"))
    r, u = sam.orderBy("rowid").collect()
    assert (r.pos, r.cigar, r.mate_chrom, r.mapped, r.mate_mapped, r.reverse, r.primary) == (5, "2S3M", "c1", True, True, False, True) and u.qual is None and not u.mapped
    assert [(x.ref_id, x.chrom, x.length) for x in T.sam_references(spark, str(tmp_path / "a.sam")).collect()] == [(0, "c1", 50)]
    sto = T.read_stockholm(spark, put(tmp_path / "a.sto", "# STOCKHOLM 1.0\n#=GF ID x\na  AC\nb  GT\n\na  GG\nb  TT\n//\n"))
    assert {(x.name, x.seq) for x in sto.collect()} == {("a", "ACGG"), ("b", "GTTT")}
    p3 = T.read_primer3(spark, put(tmp_path / "a.p3", "SEQUENCE_ID=s\nPRIMER_LEFT_0=10,5\nPRIMER_RIGHT_0=40,6\n=\n"))
    assert {(x.start, x.end, x.strand) for x in T.primer3_to_bed(p3).collect()} == {(10, 15, "+"), (35, 41, "-")}
    trf = T.read_tandem_repeats(spark, put(tmp_path / "a.dat", "head\n\nSequence: c1\n\nParameters: 2\n\n3 9 3 2.3 3 100 0 14 1 2 3 4 1.5 ACG ACGACGA\n"))
    assert [(x.chrom, x.start, x.end, x.name) for x in trf.collect()] == [("c1", 2, 9, "ACG_x2.3")]
    rm = T.read_repeat_masker(spark, put(tmp_path / "a.out", "head\n\n 463 1.3 0.6 1.7 c1 10 20 (5) C L1 LINE/L1 (0) 5 1 7\n 9 1 1 1 c1 30 40 (5) + X Y 1 2 (3) 7\n"))
    assert T.repeats_of_element(rm, "L.").count() == 2
    blast = T.read_blast(spark, put(tmp_path / "a.tab", "q\ts\t99.5\t10\t0\t0\t1\t10\t5\t14\t1e-5\t50\n"))
    assert blast.first().subject == "s" and blast.first().evalue == 1e-5
    adj = T.read_adjacency(spark, put(tmp_path / "a.adj", "a -- b 3\nbad\n"))
    assert [tuple(x) for x in adj.collect()] == [("a", "b", 3.0)]
    js = T.read_json_array(spark, put(tmp_path / "a.json", '[{"a": 1}, {"a": 2}]'))
    assert js.select(F.get_json_object("json", "$.a")).count() == 2


def test_embl(spark, tmp_path):
    text = 'ID   chr1; SV 1;\nFH   Key\nFT   CDS             complement(join(10..20,\nFT                   30..40))\nFT                   /locus_tag="g1"\nFT   gap             1..5\nFT                   /note="n"\n//\n'
    rows = T.read_embl(spark, put(tmp_path / "a.embl", text)).collect()
    assert [(r.record, r.type, r.start, r.end, r.strand, r.locus_tag, r.spans) for r in rows] == [("chr1", "CDS", 10, 40, "-", "g1", ["10..20", "30..40"])]


def bam(path):
    name, cigar, seq = b"r1\0", struct.pack("<2I", 2 << 4 | 4, 3 << 4 | 0), bytes([0x12, 0x48, 0x10])
    body = struct.pack("<iiIIiiii", 0, 5, 30 << 8 | 3, 16 << 16 | 2, 5, -1, -1, 0) + name + cigar + seq + bytes([40] * 5)
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    path.write_bytes(gzip.compress(data[:20]) + gzip.compress(data[20:]))


def test_bam(spark, tmp_path):
    bam(tmp_path / "a.bam")
    row = B.read_bam(spark, str(tmp_path / "*.bam")).first()
    assert (row.name, row.chrom, row.pos, row.cigar, row.seq, row.qual, row.reverse, row.mapq) == ("r1", "c1", 5, "2S3M", "ACGTA", [40] * 5, True, 30)
    assert B.bam_references(str(tmp_path / "a.bam")) == [("c1", 99)]


def test_two_bit(spark, tmp_path):
    seq = struct.pack("<II", 6, 1) + struct.pack("<I", 4) + struct.pack("<I", 2) + struct.pack("<I", 1) + struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", 0) + bytes([0b10011100, 0b00000000])
    data = struct.pack("<IIII", 0x1A412743, 0, 1, 0) + bytes([2]) + b"c1" + struct.pack("<I", 16 + 7) + seq
    (tmp_path / "g.2bit").write_bytes(data)
    assert [(r.chrom, r.seq) for r in B.read_two_bit(spark, str(tmp_path / "g.2bit")).collect()] == [("c1", "aCGTNN")]


def test_vcf_and_tables(spark, tmp_path):
    v = spark.createDataFrame([("c2", 4, "A", "G", 3, 9), ("c1", 7, "C", "T", 2, 8)], "chrom string, pos long, ref string, alt string, n long, depth long")
    T.write_vcf(v, str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[0] == "##fileformat=VCFv4.0" and lines[-2].startswith("c1\t8\t.\tC\tT") and len(lines) == 6
    T.write_table(v, str(tmp_path / "t"))
    assert T.read_table(spark, str(tmp_path / "t")).count() == 2
