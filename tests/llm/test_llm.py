import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm import chop, letters, near, pack, passages, reading, spans, texts, tokens


def greedy(seq, limit, step):
    """The cuts letter by letter."""
    s = [c for c in seq if c.isascii() and c.isalpha()]
    n, limit = len(s), max(1, limit)
    overlap = min(max(0, limit - step), limit - 1)
    natural = set()
    for m in re.finditer("[Nn]+", "".join(s)):
        a, b = m.span()
        natural |= set(range(a + 1, b)) if b - a > 1 else {b}
    out, start = [], 0
    while True:
        if start + limit >= n:
            return [*out, (start, n)]
        end = next((e for e in range(start + limit, start + overlap, -1) if e in natural), start + limit)
        out.append((start, end))
        start = end - overlap


def test_cuts_are_the_greedy_ones():
    rng = random.Random(4)
    for _ in range(300):
        seq = "".join(rng.choices("ACGTN", [5, 5, 5, 5, rng.choice([0, 1, 8])], k=rng.randrange(1, 160)))
        seq = re.sub("A", lambda m: "N" * rng.choice([1, 1, 1, 9]) if rng.random() < 0.05 else "A", seq)
        limit, step = rng.randrange(1, 40), rng.randrange(-3, 60)
        codes = chop.only_letters(seq)
        if len(codes) <= limit:
            continue
        ends, overlap = chop.cuts(len(codes), *chop.runs_of_n(codes), limit, step)
        starts = np.concatenate(([0], ends[:-1] - overlap))
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == greedy(seq, limit, step)


def test_pieces(spark):
    genome = spark.createDataFrame([("f", "a", "ACGTNN\nNNAC-GTACGT*", 3), ("f", "b", None, 1), ("f", "c", "", 1), (None, "d", "A" * 50, 1), ("g", "e", "acgtn" * 60, 1)], "genome_fnp string, chrom string, seq string, pars_id int")
    pars = spark.createDataFrame([(1, "f", 6, 4), (2, None, 5, 5), (3, "g", None, None), (4, "nowhere", 5, 5), (5, "f", 4, 9)], "pars_id long, genome_fnp string, window_length int, window_step int")
    rows = chop.pieces(genome, pars, with_text=True).collect()
    assert {(r.pars_id, r.chrom) for r in rows} == {(1, "a"), (3, "e"), (5, "a")}
    for key, limit, overlap in (((1, "a"), 6, 2), ((3, "e"), 100, 90), ((5, "a"), 4, 0)):
        own = sorted((r for r in rows if (r.pars_id, r.chrom) == key), key=lambda r: r.piece)
        assert own[0].start == 0 and all(len(r.text) == r.end - r.start <= limit for r in own) and all(a.end - b.start == overlap for a, b in zip(own, own[1:], strict=False))
    twice = chop.pieces(genome.unionByName(genome), pars, with_text=True)
    assert twice.count() == 2 * len(rows) == 2 * chop.pieces(genome, pars).count()
    assert chop.pieces(genome.limit(0), pars).count() == 0 and chop.pieces(genome, pars.limit(0)).count() == 0


def family(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ACGT", k=rng.randrange(15, 300))) for _ in range(8)]
    out = []
    for k in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            p = rng.randrange(len(s))
            s[p : p + rng.choice([0, 1, 1])] = rng.choice(["A", "N", "", "GG"])
        if rng.random() < 0.2:
            s = s[len(s) // 2 :] + s[: len(s) // 2]
        t = "".join(s)
        out.append((k, rng.choice([t, t.lower(), t[:9] + "-\n" + t[9:]])))
    return [*out, (900, None), (901, ""), (902, "ACG"), (None, out[0][1]), (903, "A" * 200), (904, "A" * 203), (905, "A" * 70), (906, "N" * 120), (907, "é" * 80), (908, "é" * 80)]


def plain(s):
    return re.sub(r"[-\s]", "", s).upper()


def brute_spans(rows, k=64):
    own = {r: plain(s) for r, s in rows if r is not None and s is not None}
    seen = {}
    for r, s in own.items():
        for i in range(len(s) - k + 1):
            seen.setdefault(s[i : i + k], set()).add(r)
    out = {}
    for r, s in own.items():
        covered = {p for i in range(len(s) - k + 1) if len(seen[s[i : i + k]]) > 1 for p in range(i, i + k)}
        if covered:
            out[r] = len(covered)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_shared_spans(spark, monkeypatch, hot):
    rows = family(1)
    df = spark.createDataFrame(rows, "rowid long, seq string")
    if hot:
        every = [r[0] for r in spans.seeds(df, 64, False).select("seed").distinct().collect()]
        monkeypatch.setattr(spans, "hot_seeds", lambda *_: np.sort(np.array(every[::2], np.int64).view(np.uint64)))
    assert {r.rowid: r.shared_letters for r in spans.shared_spans(df).collect()} == brute_spans(rows)
    assert spans.shared_spans(df.limit(0)).count() == 0


def brute_pairs(rows, share=0.7):
    own = {r: Counter(plain(s)[i : i + 10] for i in range(len(plain(s)) - 9)) for r, s in rows if r is not None and s is not None and len(plain(s)) >= 10}
    return {(a, b) for a in own for b in own if a < b and sum((own[a] & own[b]).values()) >= share * max(own[a].total(), own[b].total()) - 1e-9}


def test_similar_pairs(spark):
    rows = [r for seed in (2, 3) for r in family(seed)]
    rows = [(None if r is None else r + 1000 * (k >= 70), s) for k, (r, s) in enumerate(rows)]
    rng = random.Random(9)
    for k in range(60):  # short records, edits at their ends
        s = "".join(rng.choices("ACGT", k=rng.randrange(10, 44)))
        rows += [(5000 + 3 * k, s), (5001 + 3 * k, s[rng.randrange(3) :]), (5002 + 3 * k, s + rng.choice(["", "A", "CC"]))]
    df = spark.createDataFrame(rows, "rowid long, seq string").distinct()
    rows = [tuple(r) for r in df.collect()]
    expected = brute_pairs(rows)
    assert len(expected) > 200
    assert {(r.rowid_a, r.rowid_b) for r in near.similar_pairs(df).collect()} == expected
    assert near.similar_pairs(df.limit(0)).count() == 0
    parent = {r: r for r, _ in rows if r is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in expected:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    groups = {r.rowid: r.group_id for r in near.groups(df).collect()}
    assert groups == {r: find(r) for r, s in rows if r is not None and s is not None and len(plain(s)) >= 10}


def found_pairs(spark, rows):
    return {(r.rowid_a, r.rowid_b) for r in near.similar_pairs(spark.createDataFrame(rows, "rowid long, seq string")).collect()}


def test_pairs_that_share_a_repetitive_part(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    parts = ["N" * 100] * 9 + [some(3) * 40 for _ in range(4)]
    rows = list(enumerate(part + some(size) for part in parts for size in (15, 20, 30) for _ in range(2)))
    expected = brute_pairs(rows)
    assert len(expected) > 50 and found_pairs(spark, rows) == expected


def test_pairs_of_a_large_family(spark):
    rng = random.Random(13)
    rows = []
    for size, at in ((50, 0), (120, 10_000)):
        parent = rng.choices("ACGT", k=size)
        for k in range(2000):
            own = list(parent)
            for _ in range(1 if size == 50 else rng.randrange(1, 4)):
                own[rng.randrange(size)] = rng.choice("ACGT")
            rows.append((at + k, "".join(own)))
    expected = brute_pairs([r for r in rows if r[0] % 10_000 < 250])
    assert len(expected) > 10_000 and {p for p in found_pairs(spark, rows) if max(x % 10_000 for x in p) < 250} == expected


def test_pairs_of_crowded_combinations(spark, monkeypatch):
    """A primer that most records hold, in cells: records that only share it, and families behind it."""
    monkeypatch.setattr(near, "CROWD", 60)
    monkeypatch.setattr(near, "OFTEN", 30)
    rng = random.Random(14)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    primer, rows = some(40), []
    for k in range(400):
        own = some(150) if k % 4 else rows[rng.randrange(len(rows))][1][40:] if rows else some(150)
        at = rng.randrange(len(own))
        rows.append((k, primer + own[:at] + rng.choice("ACGT") + own[at + 1 :]))
    known = near.frequent(near.packed(spark.createDataFrame(rows, "rowid long, seq string")))
    assert len(known.hot) and len(known.crowded) and known.cells.max() > 1
    expected = brute_pairs(rows)
    assert len(expected) > 50 and found_pairs(spark, rows) == expected


def test_crowded_primer_is_not_sent_along_again_and_again(spark, monkeypatch):
    """Letters of records with a crowded primer come a few times into the index, whatever the number of its records."""
    monkeypatch.setattr(near, "CROWD", 20)
    monkeypatch.setattr(near, "OFTEN", 10)
    monkeypatch.setattr(near, "SAMPLE", 1.0)
    rng = random.Random(16)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    primer, rows = some(20), []
    for k in range(400):
        own = some(120) if k % 4 else rows[rng.randrange(len(rows))][1][20:] if rows else some(120)
        at = rng.randrange(len(own))
        rows.append((k, primer + own[:at] + rng.choice("ACGT") + own[at + 1 :]))
    rows += [(1000 + k, primer + some(5 + k % 7) + "ACCTG" * 20) for k in range(20)]  # unlike only next to the primer
    df = spark.createDataFrame(rows, "rowid long, seq string")
    single, _ = near.folded(near.packed(df))
    known = near.frequent(single)
    index = near.indexed(single, 0.7, 32, spark.sparkContext.broadcast(known)).where("base = -1").collect()
    assert sum(near.read_texts(r.block).num_rows for r in index) <= 4 * len(rows)
    expected = brute_pairs(rows)
    assert len(expected) > 50 and found_pairs(spark, rows) == expected


def test_arrays_of_the_index():
    """Unpacking, least places and letters beside runs against their plain definitions."""
    rng = random.Random(17)
    some = ["".join(rng.choices("ACGT" if k % 3 else "ACGTN", k=rng.randrange(10, 300))) for k in range(80)]
    codes, offsets = letters.joined(pa.array(some))
    size = np.diff(offsets)
    blobs = spans.packed_letters(codes, offsets[:-1], size, int(size.max()))
    for a, b in ((0, 80), (7, 31)):
        own, ends = near.unpacked(blobs.slice(a, b - a), size[a:b])
        assert own.tobytes().decode() == "".join(some[a:b]) and np.diff(ends).tolist() == size[a:b].tolist()
    h = letters.mixed(np.arange(500, dtype=np.uint64) // 2)
    for n in (1, 2, 9, 12, 16):
        assert near.least_places(h, n).tolist() == letters.first_least(h, n).tolist()
    for number, kind in enumerate((near.MID, near.LONG)):
        own, _, at, _, level, first, last = near.least_runs(codes, offsets, kind, number, near.NOTHING)
        assert len(at) and (at >= first).all() and (at <= last + kind.runs - 1).all() and set(level) == {near.RARE}
        two, spare = near._TWO[own], near.SIDE - kind.runs + 1
        left, right = at - first, last + kind.runs - 1 - at
        found = near.around(two, np.zeros(len(own) + 1, np.int32), at, kind, left, right, np.zeros(len(at), bool))
        for p, x, l, r in zip(at.tolist(), found.tolist(), left.tolist(), right.tolist(), strict=True):
            before = [two[p - 1 - k] for k in range(l + 1) if p - 1 - k >= 0]
            assert [x >> 2 * (spare + k) & 3 for k in range(len(before))] == before and x & (1 << 2 * spare) - 1 == 0
            assert [x >> int(near._RIGHT) + 2 * k & 3 for k in range(r)] == two[p + kind.size : p + kind.size + r].tolist()
            assert (x >> int(near._LEAST) & 15, x >> int(near._MOST) & 15) == (l + spare, r)


def test_shuffle_files_of_written_tables_are_removed(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    made = runtime.written(spark.range(1000).repartition(5, "id"), "test", drop_shuffles=True)
    assert files() <= before and made.count() == 1000
    assert all(spark.conf.get(name, None) is None for name in runtime._CLEANUP)
    folder = made.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    runtime.drop_table(made)
    assert not os.path.exists(folder)


def test_complete_index_and_steps(spark):
    rng = random.Random(15)
    rows = [(k, s) for k, (_, s) in enumerate(family(4, 40)) if s is not None]
    runs = "".join(c * 6 for c in rng.choices(["A", "C", "G", "T"], k=40))  # edits in runs of equal letters leave few unshared tokens
    rows += [(500 + k, "".join(c if k == 0 or i % 19 else "" for i, c in enumerate(runs))) for k in range(2)]
    df = spark.createDataFrame(rows, "rowid long, seq string")
    assert {(r.rowid_a, r.rowid_b) for r in near.similar_pairs(df, complete=True).collect()} == brute_pairs(rows)
    with pytest.raises(ValueError):
        near.similar_pairs(df, 0.5)
    for n in range(near.MID.least, 3000):  # edits that leave 7, 8 and 9 tokens unshared leave such a stretch
        for kind, least, cost in ((near.MID, near.MID.least, 7), (near.LONG, near.LONG.least, 9), (near.LONG, 134, 8)):
            shared, gaps = -(-7 * n // 10), (3 * n // 10) // cost
            if least <= n <= kind.most:
                assert -(-shared // (gaps + 1)) >= kind.size + kind.runs - near.TOKEN


def test_pairs_with_clashing_columns(spark):
    rows = [(1, "ACGTTGCAATGCCGATTACA" * 3, "x"), (2, "ACGTTGCAATGCCGATTACA" * 3, None), (3, None, "y"), (None, "ACGTTGCAATGCCGATTACA" * 3, "z"), (4, "", None)]
    df = spark.createDataFrame(rows, "rowid long, seq string, size string").withColumns({c: F.lit(1) for c in ("nid", "a", "b", "letters", "key", "part")})
    assert [tuple(r) for r in near.similar_pairs(df).collect()] == [(1, 2)]
    assert {(r.rowid, r.group_id, r.links) for r in near.groups(df).collect()} == {(1, 1, 0), (2, 1, 0)}


def test_pairs_of_poly_a(spark):
    rows = [(1, "A" * 100), (2, "A" * 100 + "C"), (3, "A" * 81), (4, "A" * 40 + "C" + "A" * 40), (5, "C" * 90)]
    assert found_pairs(spark, rows) == brute_pairs(rows) >= {(1, 2), (3, 4)}


def test_window_hashes():
    codes = np.frombuffer(b"ACGTACGTACGTTTACGTACGTAC", np.uint8)
    for size in (1, 2, 3, 10, 16, 24, 25):
        h = letters.windows(letters.LETTER[codes], size)
        parts = [codes[i : i + size].tobytes() for i in range(len(codes) - size + 1)]
        assert len(h) == len(parts) and len(set(h.tolist())) == len(set(parts))


def test_chains():
    value, path = passages.chained([0, 30, 60, 40], [5, 35, 70, 0], size=20)
    assert path == [0, 1, 2] and value == 60 - 0.1 * 20 - 0.1 * 25
    assert passages.chained([0, 5, 9], [0, 5, 9], size=20) == (29.0, [0, 1, 2])


def test_passages(spark):
    rng = random.Random(5)
    s = "".join(rng.choices("ACGT", k=300))
    t = s[:100] + "G" + s[101:180] + s[190:]
    df = spark.createDataFrame([(50, "TTTT" + s), (1, t), (2, "".join(rng.choices("ACGT", k=300))), (100, None)], "rowid long, seq string")
    rows = passages.passages(df).collect()
    assert [(r.query_id, r.target_id) for r in rows] == [(50, 1)] and rows[0].identity > 0.9 and rows[0].query_end - rows[0].query_start > 250


def test_passages_are_whole(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    rows, expected = [], set()
    for k in range(20):  # shared stretches of exactly 64 letters
        shared = some(64)
        rows += [(50 * k, "A" + some(40) + "C" + shared + "A" + some(30)), (50 * k + 1, some(25) + "G" + shared + "T" + some(50))]
        expected.add((50 * k, 50 * k + 1, 42, 106, 26, 90))
    one, two = some(150), some(100)
    rows += [(5000, one + "A" + two), (5001, two + "C" + one)]
    expected |= {(5000, 5001, 0, 150, 101, 251), (5000, 5001, 151, 251, 0, 100)}
    found = passages.passages(spark.createDataFrame(rows, "rowid long, seq string")).collect()
    assert {tuple(r)[:6] for r in found} == expected and all(r.identity == 1 for r in found)


TEXTS = ["", None, "Hello world", "naïve <|endoftext|> 日本語 😀", "x" * 5000 + " " + "é" * 700, "\r\n\t  \x00", "Hello world"]


def test_encoding(spark):
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    ids = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert ids[0] == [] and ids[1] == [] and ids[2] == ids[6] and 50256 not in ids[3]
    back = {r.doc_id: r.text for r in tokens.back_to_text(tokens.encoded(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    for r in tokens.with_offsets(df).where("doc_id = 3").orderBy("position").collect():
        assert TEXTS[3].encode()[r.byte_start : r.byte_end].decode(errors="replace").replace("�", "") in TEXTS[3][r.char_start : r.char_end]
    table = tokens.token_bytes(texts.loaded(texts.tokenizer_json()).get_vocab())
    assert "�" in tokens.decoded(ids[3][-1:], table) or tokens.decoded(ids[3][-1:], table) in TEXTS[3]
    assert tokens.encoded(df.limit(0)).count() == 0


def test_packing_rules(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, "word " * rng.choice([0, 1, 5, rng.randrange(120), rng.randrange(60), 700]) if k % 9 else None) for k in range(300)] + [(7, "word " * 30)], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 128), (2, 512), (3, None), (4, 0)], "spec_id long, capacity_tokens int")
    total = sum(r.tokens for r in pack.token_counts(docs, "doc_id", "text", "byte_bpe_50k", texts.TOKENIZERS).collect())
    for extra in ({}, {"segments": 4, "loss_share": 0.5, "chunk": 50}):
        rows = pack.packed(docs, specs, **extra).collect()
        assert {r.spec_id for r in rows} == {1, 2}
        for spec, capacity in ((1, 128), (2, 512)):
            own = [r for r in rows if r.spec_id == spec]
            assert {r.doc_id for r in own} == set(range(300))
            assert sum(r.tokens for r in own) == total
            held = {}
            for r in own:
                held.setdefault(r.container, []).append(r)
            most = extra.get("segments", max(16, capacity // 16))
            for items in held.values():
                assert sum(r.tokens for r in items) <= capacity and len(items) <= most
                if extra and len(items) > 1:
                    assert sum(r.loss for r in items) <= capacity // 2 and not any(r.over for r in items)
            if extra:  # all words are the author's own; a last space is a token without letters
                assert all(r.tokens - r.loss in (0, 1) and r.over == (r.loss > capacity // 2) for r in own) and any(r.over for r in own)
            for d in {r.doc_id for r in own if r.piece > 0}:
                assert sum(r.tokens for r in own if r.doc_id == d) > capacity
    loose = pack.containers(pack.packed(docs, specs), specs).collect()
    assert all(r.unused < 0.1 for r in loose)
    assert pack.packed(docs.limit(0), specs).count() == 0


def test_loss_is_counted_without_a_loss_limit(spark):
    """Every piece has its loss-bearing tokens, and containers are chosen by them too, where the loss limit is the capacity."""
    texts_ = ["> quoted words of another\n" * (k % 5) + "own words " * (k % 40) + "\u3000\u2003x" * (k % 3) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    specs = spark.createDataFrame([(1, 64)], "spec_id long, capacity_tokens int")
    rows = pack.packed(docs, specs).collect()
    tokenizer, expected = texts.loaded(texts.tokenizer_json()), {}
    for k, t in enumerate(texts_):
        e = tokenizer.encode(t, add_special_tokens=False)
        shown = texts.own_letters(t)
        flags = [bool(shown[a:b].any()) for a, b in e.offsets]
        for n, a in enumerate(range(0, max(1, len(flags)), 64)):
            expected[k, n] = sum(flags[a : a + 64])
    assert {(r.doc_id, r.piece): r.loss for r in rows} == expected and 0 < sum(expected.values()) < sum(r.tokens for r in rows)
    assert pack.broken(pack.packed(docs, specs), specs).count() == 0
    for t in ["", "a\u3000b\x85c\u2028d\x1fe", "\U0001f600 x\u00a0y", "@", "see www.x.org & [b]me[/b]"]:
        plain = t.replace("\u2028", "\n").replace("\x85", "\n")
        shown = texts.own_letters(t)
        assert len(shown) == len(t) and not any(s and c.isspace() for s, c in zip(shown, plain, strict=True))


def test_containers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 400):
        sizes = rng.integers(0, 100, n)
        bins = pack.largest_first(sizes, 100, 7)
        vector = pack.placed(np.column_stack((sizes, np.ones(n, np.int64))), np.array([100, 7]))
        assert sorted(zip(bins.tolist(), sizes.tolist(), strict=True)) == sorted(zip(vector.tolist(), sizes.tolist(), strict=True))  # the same heuristic
    assert pack.pieces_of(10, [1, 3, 5, 9], 4) == [(0, 4, 2), (4, 4, 3), (8, 2, 1)] and pack.pieces_of(9, [1, 3, 5, 9], 9) == [(0, 9, 6)]
    post = "> old words\nMy own <b>words</b>.\n[quote=a]in\n\nside[/quote] more\r\n-- \nBob"
    shown = "".join(c for c, k in zip(post, texts.own_letters(post), strict=True) if k)
    assert shown == "Myownwords.more" and len(texts.own_letters("")) == 0


def test_own_text():
    post = "> [quote=x]old\n> line[/quote]\nbob wrote:\n> hi\n[quote=a][quote=b]in[/quote]mid[/quote]My &amp; own <b>words</b> here.\n\nregards\nBob\n"
    assert texts.own_text(post).split() == "My own words here.".split()
    assert texts.own_text("Text.\n-- \nHard sig.\nSent from my x") == "Text." and texts.own_text(None) == "" and texts.own_text("[quote]never closed") == ""


def test_reading_levels(spark):
    rng = random.Random(8)
    easy, hard = ["cat", "dog", "ran", "sun", "hat", "big"], ["transperturbation", "epistemology", "heterogeneity", "precludes", "simultaneity"]
    docs = [(k, " ".join(rng.choices(hard if k % 2 else easy, k=30)) + ".", "c") for k in range(120)] + [(500, None, "c"), (501, "", "c"), (502, "> " + " ".join(hard), "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, level string")
    labels = spark.createDataFrame([(k, 5 if k % 2 else 1) for k in range(60)] + [(0, None), (None, 3), (1, 4), (9999, 2)], "doc_id long, reading_level int")
    rows = {r.doc_id: r for r in reading.reading_levels(df, labels).collect()}
    held_out = [k for k in range(60, 120)]
    assert sum((rows[k].level >= 3.5) == bool(k % 2) for k in held_out) >= 58
    assert rows[500].mean is None and rows[502].letters == 0 and rows[501].level < 3.5
    assert {r.level for r in reading.reading_levels(df, labels.limit(0)).collect()} == {None}
    assert reading.reading_levels(df.limit(0), labels).count() == 0


def test_letters_above_ascii_are_read():
    ja, ru = "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ何でも薄暗いじめじめした所でニャーニャー泣いていた。", "Все счастливые семьи похожи друг на друга"
    assert texts.own_text(ja) == ja and texts.own_text("see " + "QUJD0" * 20 + " here").split() == ["see", "here"]
    for text in (ja, ru):
        assert len(reading.grams(text)) == len(text) and len(set(reading.symbols(text).tolist())) > 6
    assert reading.symbols("Ы").tolist() == reading.symbols("ы").tolist() and len(reading.grams("--  !!")) == 3


def test_isotonic():
    knots, values = reading.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([1.0, 3, 1, 1, 5]))
    assert (np.diff(np.interp([0, 1, 2, 3, 4, 9], knots, values)) >= 0).all() and values[-1] == 5
