"""Global alignment of sequence pairs, and what is read from it: identity, mismatches, indels, trims, consensus.

Alignment is Needleman and Wunsch's with affine gaps (Gotoh) and free end gaps, run as an Arrow UDF
over distinct pairs: rows that hold the same two sequences are aligned once. Two letters match if they
are equal. Ties prefer a diagonal step, then a gap in the second sequence. The work is the product of
the lengths; pairs come from a join on shared k-mers, never from all combinations.

Defined results: a null sequence gives nulls; an empty one aligns to gaps only, with identity null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import kmers as K
from seqloom.runtime import written

RESULT = "struct<score: int, a: string, b: string, matches: int, mismatches: int, small_indels: int, large_indels: int, identity: double>"


def aligned_pair(a: str, b: str, match: int = 2, mismatch: int = -2, open_: int = 5, extend: int = 1, free_ends: bool = True) -> tuple[int, str, str]:
    """Score and both aligned strings of one pair: the plain form of aligned_rows()."""
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    low = -(10**8)
    steps = np.arange(m + 1)
    edge = lambda k: 0 if free_ends or k == 0 else -open_ - extend * (k - 1)
    best = np.array([edge(k) for k in range(m + 1)], np.int64)
    down = np.full(m + 1, low, np.int64)
    came = np.zeros((n + 1, m + 1), np.int8)  # 0 diagonal, 1 up (gap in b), 2 left (gap in a)
    longer_up, along = np.zeros((n + 1, m + 1), bool), np.zeros((n + 1, m + 1), bool)
    came[0, 1:], along[0, 2:] = 2, True
    last_column = [int(best[m])]
    for i in range(1, n + 1):
        opened = best - open_
        longer_up[i] = down - extend > opened
        down = np.maximum(down - extend, opened)
        diagonal = best[:-1] + np.where(y == x[i - 1], match, mismatch)
        row = np.maximum(np.concatenate(([edge(i)], diagonal)), np.concatenate(([low], down[1:])))
        # left gaps: the best of row[j] - open - extend * (k - j - 1) over j < k
        lead = np.maximum.accumulate(row - open_ + extend * (steps + 1))
        left = np.concatenate(([low], lead[:-1] - extend * steps[1:]))
        full = np.maximum(row, left)
        came[i, 1:] = np.where(full[1:] == diagonal, 0, np.where(full[1:] == down[1:], 1, 2))
        came[i, 0] = 1
        along[i, 1:] = np.concatenate(([False], left[1:-1] - extend == left[2:])) if m > 1 else False
        best = full
        last_column.append(int(best[m]))
    i, j = n, m
    score = int(best[m])
    if free_ends and n and m:
        bottom = int(best.argmax())
        side = int(np.argmax(last_column))
        if best[bottom] >= last_column[side]:
            score, j = int(best[bottom]), bottom
        else:
            score, i = last_column[side], side
    top, under = list(reversed(a[i:])) + ["-"] * (m - j), ["-"] * (n - i) + list(reversed(b[j:]))
    state = 0
    while i or j:
        if i == 0:
            top.append("-")
            under.append(b[j - 1])
            j -= 1
            continue
        if j == 0:
            top.append(a[i - 1])
            under.append("-")
            i -= 1
            continue
        kind = state or int(came[i, j])
        if kind == 0:
            top.append(a[i - 1])
            under.append(b[j - 1])
            i, j = i - 1, j - 1
        elif kind == 1:
            state = 1 if longer_up[i, j] else 0
            top.append(a[i - 1])
            under.append("-")
            i -= 1
        else:
            state = 2 if along[i, j] and came[i, j - 1] != 0 else 0
            top.append("-")
            under.append(b[j - 1])
            j -= 1
    return score, "".join(reversed(top)), "".join(reversed(under))


def measured(a: str | None, b: str | None) -> dict | None:
    if a is None or b is None:
        return None
    score, x, y = aligned_pair(a, b)
    first = max(len(x) - len(x.lstrip("-")), len(y) - len(y.lstrip("-")))
    last = min(len(x.rstrip("-")), len(y.rstrip("-")))
    matches = mismatches = small = large = 0
    gap, side = 0, ""
    for p, q in zip(x[first:last] + "$", y[first:last] + "$", strict=True):
        now = "a" if p == "-" else "b" if q == "-" else ""
        if now != side and gap:
            small, large = (small + 1, large) if gap <= 2 else (small, large + 1)
            gap = 0
        side = now
        if now:
            gap += 1
        elif p != "$":
            matches, mismatches = (matches + 1, mismatches) if p == q else (matches, mismatches + 1)
    size = max(0, last - first)
    return {"score": score, "a": x, "b": y, "matches": matches, "mismatches": mismatches, "small_indels": small, "large_indels": large, "identity": matches / size if size else None}


MEASURES = ["score", "a", "b", "matches", "mismatches", "small_indels", "large_indels", "identity"]
#: Cells of the matrices that one call fills; pairs of like size are aligned together.
CELLS = 12_000_000


def padded(texts: list[str], fill: int) -> np.ndarray:
    """Code points of texts as rows."""
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def filled(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, match: int = 2, mismatch: int = -2, open_: int = 5, extend: int = 1) -> tuple[np.ndarray, ...]:
    """aligned_pair()'s matrices with free ends for many pairs at once: (score, end in x, end in y, steps), where a step
    holds where a cell came from (0, 1, 2), whether a gap upwards goes on (4) and one to the left (8)."""
    rows, wide = len(x), y.shape[1]
    low, columns = np.int32(-(10**8)), np.arange(wide + 1, dtype=np.int32)
    best, down = np.zeros((rows, wide + 1), np.int32), np.full((rows, wide + 1), low)
    steps = np.zeros((x.shape[1] + 1, rows, wide + 1), np.int8)
    steps[0, :, 1:], steps[0, :, 2:] = 2, 2 | 8
    every = np.arange(rows)
    side, side_at = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    bottom, bottom_at = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    outside = columns > m[:, None]
    for i in range(1, x.shape[1] + 1):
        opened = best - open_
        longer = down - extend > opened
        down = np.maximum(down - extend, opened)
        diagonal = best[:, :-1] + np.where(y == x[:, i - 1 : i], np.int32(match), np.int32(mismatch))
        row = np.empty_like(best)
        row[:, 0] = 0
        np.maximum(diagonal, down[:, 1:], out=row[:, 1:])
        lead = np.maximum.accumulate(row - open_ + extend * (columns + 1), axis=1)
        left = np.full_like(best, low)
        left[:, 1:] = lead[:, :-1] - extend * columns[1:]
        best = np.maximum(row, left)
        step = steps[i]
        step[:, 1:] = np.where(best[:, 1:] == diagonal, 0, np.where(best[:, 1:] == down[:, 1:], 1, 2))
        step[:, 0] = 1
        step |= longer.astype(np.int8) << 2
        step[:, 2:] |= (left[:, 1:-1] - extend == left[:, 2:]).astype(np.int8) << 3
        inside = i <= n
        at = best[every, m]
        better = inside & (at > side)
        side[better], side_at[better] = at[better], i
        last = np.flatnonzero(i == n)
        if len(last):
            ends = np.where(outside[last], low, best[last])
            bottom_at[last] = ends.argmax(axis=1)
            bottom[last] = ends[np.arange(len(last)), bottom_at[last]]
    to_side = side > bottom
    empty = (n == 0) | (m == 0)
    i, j = np.where(to_side & ~empty, side_at, n), np.where(to_side | empty, m, bottom_at)
    return np.where(empty, 0, np.where(to_side, side, bottom)), i, j, steps


def aligned_rows(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, size, both aligned sequences as rows of code points) of pairs, as aligned_pair() gives them."""
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (a, b))
    x, y = padded(a, 0), padded(b, 1)
    score, i, j, steps = filled(x, y, n, m)
    rows, width = len(a), int((n + m).max(initial=0))
    out = np.full((2, rows, width), ord("-"), np.uint32)
    tail_x, tail_y = n - i, m - j  # at most one of them is positive
    size = tail_x + tail_y
    for r in np.flatnonzero(tail_x):
        out[0, r, : tail_x[r]] = x[r, i[r] : n[r]][::-1]
    for r in np.flatnonzero(tail_y):
        out[1, r, : tail_y[r]] = y[r, j[r] : m[r]][::-1]
    i, j, state = i.copy(), j.copy(), np.zeros(rows, np.int8)
    r = np.flatnonzero((i > 0) | (j > 0))
    while len(r):
        here = steps[i[r], r, j[r]]
        kind = np.where(i[r] == 0, 2, np.where(j[r] == 0, 1, np.where(state[r] > 0, state[r], here & 3)))
        edge = (i[r] == 0) | (j[r] == 0)
        up, left = kind != 2, kind != 1
        out[0, r[up], size[r[up]]] = x[r[up], i[r[up]] - 1]
        out[1, r[left], size[r[left]]] = y[r[left], j[r[left]] - 1]
        before = steps[i[r], r, np.maximum(j[r] - 1, 0)] & 3
        state[r] = np.where(edge, state[r], np.where(kind == 1, np.where(here & 4, 1, 0), np.where((kind == 2) & (here & 8 > 0) & (before != 0), 2, 0)))
        i[r] -= up
        j[r] -= left
        size[r] += 1
        r = r[(i[r] > 0) | (j[r] > 0)]
    at = size[:, None] - 1 - np.arange(width)
    turned = np.where(at >= 0, out[:, np.arange(rows)[:, None], np.maximum(at, 0)], 0)
    return score, size, turned[0], turned[1]


def measured_rows(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(matches, mismatches, small indels, large indels, overlap) of aligned rows, as measured() counts them."""
    columns = np.arange(x.shape[1])
    real = columns < size[:, None]
    gap_x, gap_y = (x == ord("-")) & real, (y == ord("-")) & real
    first = np.maximum(*(np.where((real & ~g).any(axis=1), (real & ~g).argmax(axis=1), size) for g in (gap_x, gap_y)))
    last = np.minimum(*(np.where((real & ~g).any(axis=1), x.shape[1] - (real & ~g)[:, ::-1].argmax(axis=1), 0) for g in (gap_x, gap_y)))
    inside = (columns >= first[:, None]) & (columns < last[:, None])
    both = inside & ~gap_x & ~gap_y
    matches = (both & (x == y)).sum(axis=1)
    kind = np.zeros((len(x), x.shape[1] + 2), np.int8)
    kind[:, 1:-1] = np.where(inside & gap_x, 1, np.where(inside & gap_y, 2, 0))
    row, at = np.nonzero(kind[:, 1:] != kind[:, :-1])
    starts = kind[row, at + 1] > 0
    long = np.zeros(len(row), bool)
    long[:-1] = np.diff(at) > 2
    return matches, both.sum(axis=1) - matches, np.bincount(row[starts & ~long], minlength=len(x)), np.bincount(row[starts & long], minlength=len(x)), np.maximum(0, last - first)


def _align_series(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out: list[tuple | None] = [None] * len(a)
    ok = sorted((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None), key=lambda k: (len(a.iloc[k]), len(b.iloc[k])))
    at = 0
    while at < len(ok):
        cells, upto, wide = 0, at, 0
        while upto < len(ok) and (upto == at or cells <= CELLS):
            wide = max(wide, len(b.iloc[ok[upto]]) + 1)
            upto += 1
            cells = (upto - at) * (len(a.iloc[ok[upto - 1]]) + 1) * wide
        pick = ok[at:upto]
        score, size, x, y = aligned_rows([a.iloc[k] for k in pick], [b.iloc[k] for k in pick])
        counts = np.column_stack(measured_rows(size, x, y))
        for k, s, width, p, q, c in zip(pick, score.tolist(), size.tolist(), x, y, counts.tolist(), strict=True):
            out[k] = (s, *(t[:width].tobytes().decode("utf-32-le", "surrogatepass") for t in (p, q)), *c[:4], c[0] / c[4] if c[4] else None)
        at = upto
    return pd.DataFrame([row or (None,) * len(MEASURES) for row in out], columns=MEASURES)


def alignment(a: Column, b: Column) -> Column:
    return F.pandas_udf(_align_series, RESULT)(a, b)


def aligned_pairs(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b") -> DataFrame:
    """pairs with column aln; equal pairs of sequences are aligned once."""
    distinct = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    # alignment is work out of proportion to bytes, which adaptive coalescing goes by: the number of partitions is fixed
    distinct = distinct.repartition(max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * pairs.sparkSession.sparkContext.defaultParallelism), a, b)
    return pairs.join(distinct.withColumn("aln", alignment(F.col(a), F.col(b))), [a, b], "left")


def candidate_pairs(reads: DataFrame, refs: DataFrame | None, k: int = 12, least: float = 0.0, key: str = "rowid") -> DataFrame:
    """(id_a, id_b, similarity, seq_a, seq_b) of pairs that share k-mers."""
    pairs = written(K.similarities(reads, k, refs, key, least).select("id_a", "id_b", "similarity"), "pairs")  # read twice where they are aligned
    other = reads if refs is None else refs
    return pairs.join(reads.select(F.col(key).alias("id_a"), F.col("seq").alias("seq_a")), "id_a").join(other.select(F.col(key).alias("id_b"), F.col("seq").alias("seq_b")), "id_b")


def compared(reads: DataFrame, refs: DataFrame | None = None, k: int = 12, least: float = 0.0, key: str = "rowid") -> DataFrame:
    """(id_a, id_b, similarity, score, identity, mismatches, indels) of pairs that share k-mers."""
    return aligned_pairs(candidate_pairs(reads, refs, k, least, key)).select("id_a", "id_b", "similarity", "aln.score", "aln.identity", "aln.matches", "aln.mismatches", "aln.small_indels", "aln.large_indels")


def best_matches(reads: DataFrame, refs: DataFrame, k: int = 12, least: float = 0.0, ties: str = "all", by: str = "score", key: str = "rowid") -> DataFrame:
    """(id_a, id_b, weight, measures): the best references of each read.

    ties: all (each of weight 1), first (least id), drop, split (equal weights) or unique (weights in
    proportion to the reads that match a reference alone; equal ones where there are none).
    """
    ranked = compared(reads, refs, k, least, key).withColumn("_top", F.max(by).over(Window.partitionBy("id_a"))).where(F.col(by) == F.col("_top")).drop("_top")
    ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy("id_a")))
    if ties == "first":
        return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("id_a").orderBy("id_b"))).where("_r = 1").drop("_r", "_n").withColumn("weight", F.lit(1.0))
    if ties == "drop":
        return ranked.where("_n = 1").drop("_n").withColumn("weight", F.lit(1.0))
    if ties == "unique":
        alone = ranked.where("_n = 1").groupBy("id_b").agg(F.count("*").alias("_u"))
        both = ranked.join(alone, "id_b", "left").withColumn("_u", F.coalesce("_u", F.lit(0)))
        total = F.sum("_u").over(Window.partitionBy("id_a"))
        return both.withColumn("weight", F.when(total > 0, F.col("_u") / total).otherwise(1 / F.col("_n"))).drop("_u", "_n")
    return ranked.withColumn("weight", 1 / F.col("_n") if ties == "split" else F.lit(1.0)).drop("_n")


def _different(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append([])
            continue
        p, q = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
        gap_p, gap_q = p == ord("-"), q == ord("-")
        first = max(len(t) - len(t.lstrip("-")) for t in (x, y))
        last = min(len(t.rstrip("-")) for t in (x, y))
        at = np.flatnonzero(p != q)
        at = at[(at >= first) & (at < last)]
        position = (np.cumsum(~gap_q) - ~gap_q)[at]
        out.append([{"position": int(k), "kind": "deletion" if gap_p[i] else "insertion" if gap_q[i] else "mismatch", "base_a": x[i], "base_b": y[i]} for i, k in zip(at.tolist(), position.tolist(), strict=True)])
    return pd.Series(out)


def differences(pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, position, kind, base_a, base_b): mismatches and gap letters inside the overlap; position on b from 0."""
    return pairs.select("id_a", "id_b", F.inline(_found(F.col("aln.a"), F.col("aln.b"))))


def _found(a: Column, b: Column) -> Column:
    return F.pandas_udf(_different, "array<struct<position: int, kind: string, base_a: string, base_b: string>>")(a, b)


def trimmed_to_reference(reads: DataFrame, reference: DataFrame, start: int | None = None, end: int | None = None, k: int = 12, key: str = "rowid") -> DataFrame:
    """Reads cut to what aligns within a reference's ends, or to its positions [start, end)."""
    pairs = aligned_pairs(candidate_pairs(reads, reference, k, key=key)).withColumn("_top", F.max("aln.score").over(Window.partitionBy("id_a"))).where("aln.score = _top").dropDuplicates(["id_a"])

    @F.pandas_udf("string")
    def cut(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            at, kept = 0, []
            size = len(y.replace("-", ""))
            low, high = start or 0, size if end is None else end
            for p, q in zip(x, y, strict=True):
                if (low <= at < high if q != "-" else low < at < high) and p != "-":
                    kept.append(p)
                at += q != "-"
            out.append("".join(kept))
        return pd.Series(out)

    return pairs.select(F.col("id_a").alias(key), F.col("id_b").alias("ref_id"), cut("aln.a", "aln.b").alias("seq"))


def stitched(pairs: DataFrame, least: int = 10, error: float = 0.1) -> DataFrame:
    """(…, seq, overlap, status): mates r1 and r2 (already turned) joined at their longest overlap with few enough mismatches."""

    @F.pandas_udf("struct<seq: string, overlap: int, status: string>")
    def join(r1: pd.Series, r2: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(r1, r2, strict=True):
            found = None
            for size in range(min(len(a or ""), len(b or "")), least - 1, -1):
                wrong = sum(x != y for x, y in zip(a[-size:], b[:size], strict=True))
                if wrong <= error * size:
                    found = size
                    break
            rows.append((None, 0, "no_overlap") if found is None else (a + b[found:], found, "joined"))
        return pd.DataFrame(rows, columns=["seq", "overlap", "status"])

    return pairs.withColumn("_s", join("r1", "r2")).select("*", "_s.*").drop("_s")


def called_variants(reads: DataFrame, reference: DataFrame, least: float = 2.0, fraction: float = 0.005, group: str | None = None, k: int = 12, similarity: float = 0.1) -> DataFrame:
    """(ref_id, [group,] position, kind, base_a, base_b, n, fraction): differences of collapsed reads (rowid, seq, cnt) to their best reference.

    Each distinct sequence is aligned once with the references of at least this k-mer similarity; differences count by the reads' cnt. Those of fewer than
    `least` reads are left out, and fractions (of all reads of the reference, and group) must be
    strictly above the cut-off.
    """
    keys = [group] if group else []
    haps = reads.where("seq is not null").groupBy("seq").agg(F.min("rowid").alias("rowid"))
    weights = reads.where("seq is not null").groupBy("seq", *keys).agg(F.sum("cnt").alias("w")).join(haps, "seq").select(F.col("rowid").alias("id_a"), *keys, "w")
    pairs = candidate_pairs(haps, reference, k, similarity)
    pieces = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * pairs.sparkSession.sparkContext.defaultParallelism)
    found = pairs.repartition(pieces, "id_a").withColumn("aln", alignment(F.col("seq_a"), F.col("seq_b"))).select("id_a", "id_b", "aln.score", _found(F.col("aln.a"), F.col("aln.b")).alias("at"))
    best = found.groupBy("id_a").agg(F.min_by(F.struct("id_b", "at"), F.struct(-F.col("score"), "id_b")).alias("b"))
    best = written(best.select("id_a", "b.*"), "best")  # without the aligned letters, and once
    total = best.select("id_a", "id_b").join(weights, "id_a").groupBy("id_b", *keys).agg(F.sum("w").alias("_t"))
    found = best.select("id_a", "id_b", F.inline("at")).join(weights, "id_a").groupBy("id_b", *keys, "position", "kind", "base_a", "base_b").agg(F.sum("w").alias("n"))
    out = found.where(F.col("n") >= least).join(total, ["id_b", *keys]).withColumn("fraction", F.col("n") / F.col("_t")).drop("_t")
    return out.where(F.col("fraction") > fraction).withColumnRenamed("id_b", "ref_id")
