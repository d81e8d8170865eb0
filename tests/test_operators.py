import itertools
import random
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions import sequence as S
from seqloom.operators import align as A
from seqloom.operators import features as G
from seqloom.operators import info as I
from seqloom.operators import intervals as V
from seqloom.operators import kmers as K
from seqloom.operators import meta as M
from seqloom.operators import networks as N
from seqloom.operators import pileup as P
from seqloom.operators import reads as R
from seqloom.operators import search
from seqloom.operators import simulate as X
from seqloom.streaming import windows

SEQS = ["ACGTACGTNN", "", None, "AAAAAA", "acgt-", "GATTACA", "GATTACA", "A"]


@pytest.fixture(scope="module")
def reads(spark):
    rows = [(k, f"r{k % 6}", s, [20 + i % 15 for i in range(len(s))] if s is not None else None, float(k % 3 + 1)) for k, s in enumerate(SEQS)]
    return spark.createDataFrame(rows, "rowid long, name string, seq string, qual array<int>, cnt double")


def by_id(df, column="seq"):
    return {r["rowid"]: r[column] for r in df.collect()}


def test_trimming(reads):
    assert by_id(R.trim_front(reads, 2))[0] == "GTACGTNN" and by_id(R.trim_front(reads, 20))[0] == ""
    assert by_id(R.trim_edges(reads, 3, 3))[5] == "T" and by_id(R.trim_edges(reads, 3, 3))[2] is None
    assert by_id(R.strip_base(reads, "A", "A"))[3] == ""
    assert by_id(R.trim_at_last(reads, "A"))[5] == "GATTAC"
    assert by_id(R.trim_to_length(reads, 4), "on")[7] is False
    assert all(len(q or []) == len(s or "") for s, q in [(r.seq, r.qual) for r in R.strip_quality(reads, 22, 25).collect()])


def test_splits_are_partitions(reads):
    for flagged in (R.flag_length(reads, 3, 8), R.flag_contains(reads, "AA", 2), R.flag_name(reads, "r1"), R.flag_quality_windows(reads, 3, 1, 22.0)):
        assert flagged.where("include").count() + flagged.where("not include").count() == len(SEQS)


def test_collapse_and_back(reads):
    small = R.collapsed(reads, names=True)
    assert small.agg(F.sum("records")).first()[0] == len(SEQS) - 1
    assert by_id(R.uncollapsed(small, R.members(reads))) == by_id(reads.where("seq is not null"))
    assert R.collapsed(reads.limit(0)).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=40), min_size=1, max_size=5))
def test_reverse_complement_twice(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    assert [r[0] for r in df.select(S.reverse_complement(S.reverse_complement(F.col("seq")))).collect()] == seqs


def test_functions(spark):
    df = spark.createDataFrame([("ATGTAAGGNAA",)], "s string")
    s = F.col("s")
    row = df.select(S.translated(s), S.kmers(s, 9), S.kmers(s, 12), S.gc_fraction(s), S.homopolymers(s), S.hamming(s, F.reverse(s))).first()
    assert row[0] == "M*X" and row[1] == ["ATGTAAGGN", "TGTAAGGNA", "GTAAGGNAA"] and row[2] == [] and row[3] == pytest.approx(3 / 11)
    assert "".join(row[4]) == "ATGTAAGGNAA" and row[4][4] == "AA"


def test_renamed_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("rowid"), F.lit("x").alias("name"))
    assert by_id(R.renamed(df, "s"), "name") == {k: f"s.{k:06d}" for k in range(1000)}


def test_diversity(spark):
    haps = spark.createDataFrame([("p", "A", 2.0), ("p", "B", 2.0), ("q", "A", 4.0)], "pop string, seq string, n double")
    d = I.diversity(I.with_fraction(haps.groupBy("seq").agg(F.sum("n").alias("n")))).first()
    assert d.haplotypes == 2 and d.he == pytest.approx(1 - (0.75**2 + 0.25**2))
    m = I.differentiation(haps, "pop").first()
    hs, ht = (0.5 + 0) / 2, 1 - (0.75**2 + 0.25**2)
    assert m.gst == pytest.approx((ht - hs) / ht) and m.jost_d == pytest.approx(2 * (ht - hs) / (1 - hs))
    assert I.pairwise_differentiation(haps, "pop").count() == 1


@pytest.fixture(scope="module")
def regions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("xyz"), a := rng.randrange(3000), a + rng.choice([0, 1, 5, 40, 900]), rng.choice("+-"), f"n{k % 20}", float(rng.randrange(9))) for k in range(200)]
    return spark.createDataFrame([*rows, (500, None, 1, 5, "+", None, None), (501, "x", None, 5, "+", "n", 1.0)], "rowid long, chrom string, start long, end long, strand string, name string, score double")


def test_overlaps_against_brute_force(regions):
    rows = [r for r in regions.collect() if r.chrom and r.start is not None and r.start < r.end]
    for width in (16, 1 << 10):
        got = sorted((r.rowid, r.rowid_b) for r in V.overlapping(regions, regions, width=width).collect())
        assert got == sorted((a.rowid, b.rowid) for a in rows for b in rows if a.chrom == b.chrom and a.start < b.end and b.start < a.end)
    semi, anti = V.overlapping(regions, regions.limit(5), how="left_semi").count(), V.overlapping(regions, regions.limit(5), how="left_anti").count()
    assert semi + anti == regions.count()


def test_merge_and_coverage_agree(regions):
    merged, steps = V.merged(regions, width=64).collect(), V.coverage_steps(regions).collect()
    assert sum(r.records for r in merged) == regions.where("chrom is not null and start < end").count()
    assert sum(r.end - r.start for r in steps) == sum(r.end - r.start for r in merged)


def test_greedy_choice(regions):
    ok = regions.where("chrom is not null and start < end")
    taken, expected = {r.rowid for r in V.best_non_overlapping(ok).collect()}, []
    for r in sorted(ok.collect(), key=lambda r: (-r.score, r.rowid)):
        if all(r.chrom != t.chrom or r.start >= t.end or t.start >= r.end for t in expected):
            expected.append(r)
    assert taken == {r.rowid for r in expected}
    rows = V.plot_rows(ok).collect()
    assert not [1 for a in rows for b in rows if a.rowid < b.rowid and a.chrom == b.chrom and a.row == b.row and a.start < b.end and b.start < a.end]


def test_meta(spark):
    df = spark.createDataFrame([(1, "a[x=1;y=2;x=3]", {"x": "0", "z": "9"}), (2, "b", None), (3, None, {})], "rowid long, name string, meta map<string,string>")
    out = {r.rowid: r for r in M.from_name(df).collect()}
    assert out[1]["meta"] == {"x": "3", "y": "2", "z": "9"} and out[1]["name"] == "a"
    flagged = by_id(M.flag_numeric(df, "z", 5), "include")
    assert flagged == {1: True, 2: True, 3: True}


def test_hierarchy(spark):
    rows = [(1, "g", {"ID": "a"}), (2, "m", {"ID": "b", "Parent": "a"}), (3, "m", {"ID": "c", "Parent": "b,zzz"}), (4, "m", {"ID": "d", "Parent": "q"}), (5, "x", None)]
    df = spark.createDataFrame(rows, "rowid long, type string, attributes map<string,string>")
    assert by_id(G.with_descendants(df, ["a"]), "depth") == {1: 0, 2: 1, 3: 2}


def test_kmer_similarity(spark):
    df = spark.createDataFrame([(1, "AAAAC"), (2, "AAAG"), (3, "TT"), (4, None)], "rowid long, seq string")
    rows = K.similarities(df, 3).collect()
    assert [(r.id_a, r.id_b, r.shared) for r in rows] == [(2, 1, 1)] and rows[0].similarity == 0.5
    best = {r.id: r.ref_id for r in K.best_reference(df, df.where("rowid = 2"), 3).collect()}
    assert best == {1: 2, 2: 2, 3: None, 4: None}


def test_tandem_runs(spark):
    df = spark.createDataFrame([("c", "GGATATATCC")], "chrom string, seq string")
    assert {(r.start, r.end, r.unit) for r in K.microsatellites(df, (2,)).collect()} == {(2, 8, "AT")}
    assert [(r.start, r.repeats) for r in K.tandem_motifs(df, "AT", 3).where("strand = '+'").collect()] == [(2, 3)]


def test_alignment():
    assert A.aligned_pair("ACGTACGT", "ACGTACGT")[0] == 16
    assert A.aligned_pair("ACGTTTACGT", "ACGTACGT", free_ends=False)[1:] in {("ACGTTTACGT", "ACG--TACGT"), ("ACGTTTACGT", "ACGT--ACGT"), ("ACGTTTACGT", "ACGTT--CGT")} or A.aligned_pair("ACGTTTACGT", "ACGTACGT", free_ends=False)[0] == 16 - 6
    assert A.measured("", "ACG")["identity"] is None and A.measured(None, "A") is None
    m = A.measured("GGACGTACGAACGT", "ACGTACGTACGTTT")
    assert m["matches"] == 11 and m["mismatches"] == 1


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGT", max_size=12))
def test_alignment_score_is_best(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, state):
        if i == len(a) and j == len(b):
            return 0
        options = []
        if i < len(a) and j < len(b):
            options.append((2 if a[i] == b[j] else -2) + best(i + 1, j + 1, 0))
        if i < len(a):
            options.append((-1 if state == 1 else -5) + best(i + 1, j, 1))
        if j < len(b):
            options.append((-1 if state == 2 else -5) + best(i, j + 1, 2))
        return max(options)

    score, x, y = A.aligned_pair(a, b, free_ends=False)
    assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    assert score == best(0, 0, 0)


def test_networks(spark):
    edges = spark.createDataFrame([(k, k + 1, float(k % 5)) for k in range(40) if k != 20] + [(0, 3, 9.0), (None, 3, 1.0)], "id_a long, id_b long, distance double")
    parts = {r.node: r.component for r in N.components(edges).collect()}
    assert parts == {k: 0 if k <= 20 else 21 for k in range(41)}
    assert N.minimum_tree(edges.where("id_a is not null")).count() == 39
    nodes = spark.createDataFrame([(k, float(100 - k)) for k in range(42)], "rowid long, cnt double")
    clusters = {r.rowid: r.cluster for r in N.greedy_clusters(nodes, edges).collect()}
    assert clusters[0] == 0 and clusters[1] == 0 and clusters[3] == 0 and clusters[41] == 41 and len(clusters) == 42


def test_variant_rule(spark):
    rows = [("c", 5, "+", True, "A", 10), ("c", 5, "-", True, "A", 10), ("c", 5, "+", True, "G", 5), ("c", 5, "-", True, "G", 5), ("c", 6, "+", True, "T", 20), ("c", 6, "+", True, "C", 5), ("c", 7, "+", True, "A", 5), ("c", 7, "-", True, "G", 5)]
    piles = spark.createDataFrame(rows, "chrom string, pos long, strand string, hq boolean, base string, n long")
    ref = spark.createDataFrame([("c", 5, "A"), ("c", 6, "T"), ("c", 7, "A")], "chrom string, pos long, ref string")
    found = P.variants(piles, ref, depth=10, fraction=0.01, bias=0.2).collect()
    assert [(r.pos, r.alt, r.fraction, r.forward) for r in found] == [(5, "G", pytest.approx(1 / 3), 0.5)]  # one strand only at 6, depth at the cut-off at 7


def test_simulation_is_stable(spark):
    df = X.random_sequences(spark, 50, 10, 30, 3)
    again = {r.rowid: (r.seq, tuple(r.qual)) for r in X.random_sequences(spark, 50, 10, 30, 3).repartition(3).collect()}
    assert {r.rowid: (r.seq, tuple(r.qual)) for r in df.collect()} == again and all(10 <= len(s) <= 30 for s, _ in again.values())


def test_transcripts(spark):
    rows = [(1, "CDS", "c", 1, 6, "-", {"Parent": "t"}), (2, "CDS", "c", 10, 12, "-", {"Parent": "t"}), (3, "CDS", "c", 1, 3, "+", {"Parent": "u"}), (4, "gene", "c", 1, 3, "+", None)]
    df = spark.createDataFrame(rows, "rowid long, type string, seqid string, start long, end long, strand string, attributes map<string,string>")
    genome = spark.createDataFrame([("c", "TTACCAGGGCAT")], "chrom string, seq string")
    found = {r.parent: (r.cdna, r.protein) for r in G.coding_sequences(df, genome).collect()}
    assert found == {"t": ("ATGTGGTAA", "MW*"), "u": ("TTA", "L")}
    spans = spark.createDataFrame([("t", 0, 4)], "id string, cdna_start long, cdna_end long")
    assert [(r.start, r.end) for r in G.transcript_span(df, spans).collect()] == [(5, 12)]
    want = spark.createDataFrame([("t", 2)], "id string, aa int")
    assert [(r.start, r.end) for r in G.amino_acids_to_bed(df, want).collect()] == [(3, 6)]


def test_called_variants(spark):
    ref = "ACGTTGCAAGGCTTACGATCCGTAAGCTTGCAACGGTT"
    snp, gap = ref[:15] + "T" + ref[16:], ref[:20] + ref[21:]
    reads = spark.createDataFrame([(1, ref, 6.0), (2, snp, 3.0), (3, gap, 1.0), (4, snp, 1.0), (5, None, 9.0)], "rowid long, seq string, cnt double")
    found = A.called_variants(reads, spark.createDataFrame([(0, ref)], "rowid long, seq string"), 2.0, 0.1, k=8).collect()
    assert [(r.position, r.kind, r.base_a, r.base_b, r.n) for r in found] == [(15, "mismatch", "T", ref[15], 4.0)] and found[0].fraction == pytest.approx(4 / 11)


def semi_global_score(text, target):
    """Best score of the whole target in any part of the text, letter by letter."""
    low = -(10**9)
    best, down = [0] * (len(text) + 1), [low] * (len(text) + 1)
    for letter in target:
        row, below, along = [], [], low
        for j in range(len(text) + 1):
            below.append(max(down[j] - 1, best[j] - 5))
            step = best[j - 1] + (2 if text[j - 1] == letter else -2) if j else low
            base = max(step, below[j])
            row.append(max(base, along))
            along = max(along - 1, base - 5)
        best, down = row, below
    return max(best)


def test_places_of_a_target():
    rng = random.Random(5)
    for _ in range(200):
        target, text = ("".join(rng.choices("ACGT", k=rng.randrange(1, n))) for n in (12, 40))
        if rng.random() < 0.6:
            own = list(target)
            own[2:3] = rng.choice(["", "A", "CC"])
            text = text[:9] + "".join(own) + text[9:]
        score, start, end, matches, columns = search.places_in([text], target)[0]
        assert score == semi_global_score(text, target) and 0 <= start <= end <= len(text) and matches <= min(len(target), end - start) and columns >= max(len(target), end - start)
        assert matches < len(target) or columns > matches or text[start:end] == target
    assert search.places_in(["TTTACGTTT", ""], "ACG") == [(6, 3, 6, 3, 3), None]


def test_cuts_at_targets(spark):
    front, back = "ACGTTGCAAT", "GGCATCATTC"
    rows = [(1, "TT" + front + "CCCC" + back + "A"), (2, "TT" + front[:4] + "A" + front[5:] + "CCCC"), (3, "T" * 30), (4, None), (5, ""), (6, back + "CC" + front)]
    df = spark.createDataFrame(rows, "rowid long, seq string")
    take = lambda t: {r.rowid: (r.on, r.seq) for r in t.collect()}
    assert take(search.trimmed_between(df, front, back, keep=False)) == {1: (True, "CCCC"), **{k: (False, s) for k, s in rows[1:]}}
    before, upto = take(search.trimmed_before(df, front, keep=False)), take(search.trimmed_from(df, front))
    assert before[1] == (True, "CCCC" + back + "A") and before[2] == (True, "CCCC") and before[3] == (False, "T" * 30) and before[4] == (False, None) and upto[1] == (True, "TT" + front)
    turned = df.withColumn("seq", F.when(F.col("rowid") == 1, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    found = {r.rowid: (r.start, r.end, r.reverse) for r in search.holding(turned, front, 0.8, 0.8, both_strands=True).collect()}
    assert found == {1: (15, 25, True), 2: (2, 12, False), 6: (12, 22, False)}
    assert search.located(df.limit(0), front).count() == 0


def test_rows_align_as_pairs():
    rng = random.Random(3)
    pairs = [(None, "A"), ("", ""), ("", "AC"), ("AC", ""), ("éé", "aéé")]
    for _ in range(150):
        a = "".join(rng.choices("ACGT", k=rng.choice([1, 2, 5, 30, 60])))
        b = list(a)
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.choice([0, 1, 3])] = rng.choice(["", "A", "GG", "TTT"])
        pairs.append((a, "".join(b) if rng.random() < 0.8 else "".join(rng.choices("ACGT", k=20))))
    rows = A._align_series(*(pd.Series(c) for c in zip(*pairs, strict=True)))
    for (a, b), (_, row) in zip(pairs, rows.iterrows(), strict=True):
        plain = A.measured(a, b)
        if plain is None:
            assert row["a"] is None
        else:
            assert {k: row[k] for k in A.MEASURES[:-1]} == {k: plain[k] for k in A.MEASURES[:-1]} and (row["identity"] == plain["identity"] or plain["identity"] is None)


def test_best_references_by_join_and_by_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    refs = [(k, "".join(rng.choices("ACGT", k=60))) for k in range(5)] + [(7, None), (8, "AC")]
    reads = [(100 + k, refs[k % 5][1][k : 40 + k]) for k in range(12)] + [(200, None), (201, "ACG"), (202, refs[0][1]), (202, refs[0][1])]
    a, b = (spark.createDataFrame(t, "rowid long, seq string") for t in (reads, refs))
    take = lambda: sorted(tuple(r) for t in (K.best_reference(a, b, 8), K.best_reference(a, b, 8, ties=True)) for r in t.collect() if r.id < 202)
    fast = take()
    monkeypatch.setattr(K, "sent_references", lambda *_: None)
    assert take() == fast and len(fast) > 12
    assert K.best_reference(a.limit(0), b, 8).count() == 0 and K.best_reference(a, b.limit(0), 8).where("ref_id is null").count() == len(reads)


def test_stream_leaves_out_late_rows(spark, tmp_path):
    arrivals = [(1, "2024-01-01 10:05:00"), (2, "2024-01-01 15:00:00")], [(4, "2024-01-01 20:00:00")], [(3, "2024-01-01 10:06:00"), (5, "2024-01-01 23:00:00")]
    for k, rows in enumerate(arrivals):
        t = spark.createDataFrame(rows, "id long, ts string").selectExpr("id", "cast(ts as timestamp) as ts", "1.0 as value")
        t.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = windows.read_stream(spark, str(tmp_path / "in/*"), "id bigint, ts timestamp, value decimal(2,1)", 1)
    windows.closed_windows(windows.windowed(stream, "ts", [], "value", size="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    closed = sorted((r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert (10, 1) in closed and (10, 2) not in closed  # row 3 came after the watermark had passed its window
    windows.run_to_end(windows.windowed(stream, "ts", [], "value", size="1 hour"), str(tmp_path / "all"), str(tmp_path / "state2"))
    assert sum(r.n for r in spark.read.parquet(str(tmp_path / "all")).collect()) == 5


def test_shared_folder_is_told_on_clusters():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = Context

    with pytest.raises(ValueError):
        runtime.shared_dir(Session)


def test_barcodes_with_an_error(spark):
    barcodes = spark.createDataFrame([(1, "ACGTACGT"), (2, "TTTTGGGG"), (3, None)], "id long, barcode string")
    rows = [(1, "ACGTACGTCC"), (2, "ACGTACTTCC"), (3, "ACGAACTTCC"), (4, "AACCCCAAAA"), (5, None), (6, "ACG")]
    found = R.demultiplexed(spark.createDataFrame(rows, "rowid long, seq string"), barcodes, 1)
    assert {r.rowid: (r.barcode_id, r.reverse) for r in found.collect()} == {1: (1, False), 2: (1, False), 3: (None, None), 4: (2, True), 5: (None, None), 6: (None, None)}


def test_smallest_k_without_repeats(spark):
    df = spark.createDataFrame([(1, "ACGTACGTT"), (2, "GGATC"), (3, None), (4, "")], "rowid long, seq string")
    assert K.smallest_unique_k(df) == 5


def _family():
    """Related sequences of 60 letters, a repeat, a run of N, and ones that are short, empty or null."""
    rng = random.Random(11)
    roots = ["".join(rng.choices("ACGT", k=60)) for _ in range(3)]
    rows = [(k, "".join(c if rng.random() > 0.05 else rng.choice("ACGT") for c in roots[k % 3])) for k in range(18)]
    return [*rows, (20, "AC" * 20), (21, "N" * 30 + roots[0][:20]), (22, "ACG"), (23, ""), (24, None), (25, "N" * 35)]


def _plain_similarities(a, b, k):
    count = lambda s: Counter(s[i : i + k] for i in range(len(s or "") - k + 1))
    found = {}
    for (x, s), (y, t) in itertools.product(a, b):
        if shared := sum((count(s) & count(t)).values()):
            found[x, y] = shared / (min(len(s), len(t)) - k + 1)
    return found


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(K, "PART_LETTERS", 300)
    monkeypatch.setattr(K, "COLLECTED_LETTERS", 700)


def test_similarities_over_lengths_in_parts(spark, small_parts):
    rows = _family()
    df = spark.createDataFrame(rows, "rowid long, seq string")
    found = K.over_lengths(df, [4, 7])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan  # exploded k-mers were joined, and broadcast by what their table's size told
    want = {(x, y, k): pytest.approx(v) for k in (4, 7) for (x, y), v in _plain_similarities(rows, rows, k).items() if x > y}
    assert {(r.id_a, r.id_b, r.k): r.similarity for r in found.collect()} == want
    assert {(r.id_a, r.id_b) for r in K.similarities(df, 7, least=0.5).collect()} == {(x, y) for (x, y, k), v in want.items() if k == 7 and v.expected >= 0.5}


def test_joined_kmers_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(K, "sent_references", lambda *_, **__: None)
    df = spark.createDataFrame(_family(), "rowid long, seq string")
    assert "BroadcastHashJoin" not in K.similarities(df, 5)._jdf.queryExecution().executedPlan().toString()


def test_decay_in_parts(spark, small_parts):
    rows = _family()
    found = K.decay(spark.createDataFrame(rows, "rowid long, seq string"), [7, 4, 5])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    a, b, c = ({pair: v for pair, v in _plain_similarities(rows, rows, k).items() if pair[0] > pair[1]} for k in (4, 5, 7))
    assert {(r.id_a, r.id_b): r.decay for r in found.collect()} == {p: pytest.approx((abs(b.get(p, 0) - a.get(p, 0)) + abs(c.get(p, 0) - b.get(p, 0))) / 2) for p in {*a, *b, *c}}


def test_scanning_in_parts(spark, small_parts):
    rows = _family()
    df = spark.createDataFrame(rows, "rowid long, seq string")
    found = K.scanning(df, df, 6, 20, 10)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    wins = [((x, at), s[at : at + 20]) for x, s in rows for at in range(0, len(s or "") - 19, 10)]
    assert {((r.id_a, r.start), r.id_b): r.similarity for r in found.collect()} == {p: pytest.approx(v) for p, v in _plain_similarities(wins, rows, 6).items()}


@pytest.mark.parametrize(("k", "least"), [(4, 7), (5, 5), (6, 3)])
def test_streaks_in_parts(spark, small_parts, k, least):
    rows = _family()
    chroms = [("c1", "GG" + rows[0][1][5:40] + "T" + rows[4][1] + "N" * 33), ("c2", turned_over(rows[7][1])), ("c3", "ACG"), ("c4", None)]
    found = K.exact_streaks(spark.createDataFrame(rows, "rowid long, seq string"), spark.createDataFrame(chroms, "chrom string, seq string"), k, least)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for (x, s), reverse, (c, g) in itertools.product(rows, (False, True), chroms):
        q = turned_over(s) if s and reverse else s
        for i, j in itertools.product(range(len(q or "")), range(len(g or ""))):
            if q[i] == g[j] and (i == 0 or j == 0 or q[i - 1] != g[j - 1]):
                n = next((n for n in range(min(len(q) - i, len(g) - j)) if q[i + n] != g[j + n]), min(len(q) - i, len(g) - j))
                if n >= max(k, least):
                    want.add((x, c, reverse, i, j, n))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 20


def turned_over(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_both_strands_in_parts(spark, small_parts):
    rows = _family()
    df = spark.createDataFrame(rows, "rowid long, seq string")
    found = K.similarities_both_strands(df, 6, df)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    forward, reverse = _plain_similarities(rows, rows, 6), _plain_similarities([(x, turned_over(s) if s else s) for x, s in rows], rows, 6)
    assert {(r.id_a, r.id_b): (r.forward, r.reverse) for r in found.collect()} == {p: (pytest.approx(forward.get(p, 0)), pytest.approx(reverse.get(p, 0))) for p in {*forward, *reverse}}


def test_best_references_in_parts(spark, small_parts):
    rows = _family()
    df = spark.createDataFrame(rows, "rowid long, seq string")
    every = _plain_similarities(rows, rows[:12], 6)
    best = {r.id: r.ref_id for r in K.best_reference(df, df.where("rowid < 12"), 6).collect()}
    assert best == {x: min(((-v, y) for (a, y), v in every.items() if a == x), default=(0, None))[1] for x, _ in rows}


def test_called_variants_align_once(spark, small_parts):
    rows = _family()
    reads = spark.createDataFrame([(*r, 1.0 + r[0] % 4, f"s{r[0] % 2}") for r in rows], "rowid long, seq string, cnt double, sample string")
    refs = spark.createDataFrame([(100 + x, s) for x, s in rows[:6]], "rowid long, seq string")
    found = A.called_variants(reads, refs, 2.0, 0.05, "sample", k=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan  # both the totals and the differences aligned every pair
    want, total = Counter(), Counter()
    for x, s in rows:
        near = [(-A.measured(s, t)["score"], y) for (_, y), v in _plain_similarities([(x, s)], [(100 + k, u) for k, u in rows[:6]], 6).items() if v >= 0.1 for t in [rows[y - 100][1]]]
        if near:
            ref, sample, weight = min(near)[1], f"s{x % 2}", 1.0 + x % 4
            _, p, q = A.aligned_pair(s, rows[ref - 100][1])
            total[ref, sample] += weight
            for d in A._different(pd.Series([p]), pd.Series([q]))[0]:
                want[ref, sample, d["position"], d["kind"], d["base_a"], d["base_b"]] += weight
    want = {v: n for v, n in want.items() if n >= 2 and n / total[v[:2]] > 0.05}
    assert {(r.ref_id, r.sample, r.position, r.kind, r.base_a, r.base_b): r.n for r in found.collect()} == want and len(want) > 5


def test_network_edges_without_a_kmer_join(spark, small_parts):
    rows = _family()
    found = N.nearest_events(A.compared(spark.createDataFrame(rows, "rowid long, seq string"), None, 6, 0.1))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    texts = dict(rows)
    events = {p: sum(A.measured(texts[p[0]], texts[p[1]])[m] for m in ("mismatches", "small_indels", "large_indels")) for p, v in _plain_similarities(rows, rows, 6).items() if p[0] > p[1] and v >= 0.1}
    least = {x: min(n for p, n in events.items() if x in p) for p in events for x in p}
    assert {(r.id_a, r.id_b): r.events for r in found.collect()} == {p: n for p, n in events.items() if n in (least[p[0]], least[p[1]])}


@pytest.mark.parametrize("merge", [N.greedy_clusters, N.tandems_collapsed])
def test_edges_are_made_once(spark, small_parts, merge):
    rows = _family()
    nodes = spark.createDataFrame([(*r, float(r[0] % 5)) for r in rows], "rowid long, seq string, cnt double")
    found = merge(nodes, K.similarities(nodes, 6, least=0.5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" not in plan
    edges = {p for p, v in _plain_similarities(rows, rows, 6).items() if v >= 0.5 and p[0] != p[1]}
    count = {x: float(x % 5) for x, _ in rows}
    if merge is N.tandems_collapsed:
        up = {x: min(((-count[y], y) for y in count if (x, y) in edges and count[y] >= 2 * count[x]), default=(0, x))[1] for x in count}
        for _ in count:
            up = {x: up[y] for x, y in up.items()}
        assert {r.rowid: r.into for r in found.collect()} == up
        return
    centres, want = [], {}
    for x in sorted(count, key=lambda x: (-count[x], x)):
        want[x] = next((y for y in centres if (x, y) in edges), x)
        centres += [x] * (want[x] == x)
    assert {r.rowid: r.cluster for r in found.collect()} == want
