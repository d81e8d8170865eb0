"""Operators over intervals: DataFrames with chrom, start, end (0-based, half-open) and optionally
name, score, strand, rowid.

Overlaps are joined by equality on (chrom, bin): each interval is listed in the bins of a fixed width
that it touches, and a pair is kept in the first bin that both touch, so no distinct is needed. A hot
chromosome is spread over its bins, so no chromosome goes to one task; running maxima over a
chromosome are taken per bin first and then carried over the bins' summaries.

Defined results: intervals with a null bound or chromosome overlap nothing; touching intervals (end =
start) don't overlap but merge; empty ones (end <= start) overlap nothing; repeated rows are separate
intervals; the other side's columns get a suffix, so that names don't clash.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.runtime import small_or_plain

BIN = 1 << 10


def _binned(df: DataFrame, width: int, extra: int = 0) -> DataFrame:
    ok = df.where("chrom is not null and start < end")
    first, last = F.floor((F.col("start") - extra) / width), F.floor((F.col("end") - 1 + extra) / width)
    return ok.select("*", F.explode(F.sequence(first, last)).alias("_bin"), first.alias("_first"))


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c + suffix) for c in df.columns])


def overlapping(a: DataFrame, b: DataFrame, least: int = 1, width: int = BIN, how: str = "inner", suffix: str = "_b") -> DataFrame:
    """Pairs with at least so many shared positions; column shared. how: inner, left_semi or left_anti (then only a's columns).

    For least = 0 an interval of a must contain all of b's or be contained in it.
    """
    right = suffixed(_binned(b, width), suffix)
    left = _binned(a, width)
    shared = F.least("end", f"end{suffix}") - F.greatest("start", f"start{suffix}")
    enough = shared >= least if least > 0 else (shared == F.least(F.col("end") - F.col("start"), F.col(f"end{suffix}") - F.col(f"start{suffix}")))
    on = (F.col("chrom") == F.col(f"chrom{suffix}")) & (F.col("_bin") == F.col(f"_bin{suffix}")) & enough
    if how == "inner":
        on = on & (F.col("_bin") == F.greatest("_first", f"_first{suffix}"))
        return left.join(right, on).withColumn("shared", shared).drop("_bin", "_first", f"_bin{suffix}", f"_first{suffix}")
    own = [c for c, kind in a.dtypes if "map<" not in kind]  # rows equal in these overlap the same
    hits = left.join(right, on).select(*[F.col(f"`{c}`").alias(f"_h{k}") for k, c in enumerate(own)]).distinct()
    same = functools.reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate(own)])
    return a.join(hits, same, how)


def overlap_lists(a: DataFrame, b: DataFrame, least: int = 1, key: str = "rowid") -> DataFrame:
    """a's overlapping rows with column hits: the other side's names in order, joined by commas."""
    pairs = overlapping(a, b, least)
    keep = a.columns
    return pairs.groupBy(*keep).agg(F.array_join(F.array_sort(F.collect_list("name_b")), ",").alias("hits"))


def containing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that lie inside a row of b, once for each."""
    return overlapping(a, b).where("start >= start_b and end <= end_b")


def with_length_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", (F.col("end") - F.col("start")).cast("double"))


def extended(df: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    return with_length_score(df.withColumns({"start": F.greatest(F.col("start") - left, F.lit(0)), "end": F.col("end") + right}))


def _minus() -> Column:
    return F.col("strand") == "-"


def extended_stream(df: DataFrame, n: int, up: bool) -> DataFrame:
    """Longer by n at the upstream or downstream side of the strand, from 0 on."""
    at_start = ~_minus() if up else _minus()
    return df.withColumns({"start": F.when(at_start, F.greatest(F.col("start") - n, F.lit(0))).otherwise(F.col("start")), "end": F.when(at_start, F.col("end")).otherwise(F.col("end") + n)})


def stream_region(df: DataFrame, n: int, include: int, up: bool) -> DataFrame:
    """The n positions upstream or downstream of the strand, and the first `include` inside."""
    at_start = ~_minus() if up else _minus()
    start = F.when(at_start, F.greatest(F.col("start") - n, F.lit(0))).otherwise(F.greatest(F.col("end") - include, F.lit(0)))
    end = F.when(at_start, F.col("start") + include).otherwise(F.col("end") + n)
    return df.withColumns({"start": start, "end": end})


def toggled(df: DataFrame) -> DataFrame:
    return df.withColumn("strand", F.when(_minus(), "+").otherwise("-"))


def to_bed6(df: DataFrame) -> DataFrame:
    """Three-column intervals with name chrom-start-end, their length as score, and strand +."""
    return with_length_score(df.withColumns({"name": F.concat_ws("-", "chrom", "start", "end"), "strand": F.lit("+")}))


def named_by_place(df: DataFrame) -> DataFrame:
    return df.withColumn("old_name", F.col("name")).withColumn("name", F.concat(F.concat_ws("-", "chrom", "start", "end"), F.when(_minus(), "-rev").otherwise("-for")))


def unique(df: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """One row for equal places; the names in order, joined by '-'."""
    keys = ["chrom", "start", "end"] + ([] if ignore_strand else ["strand"])
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("name")), "-").alias("name"), F.count("*").alias("records"))


def repeats_renamed(df: DataFrame, width: int = 3) -> DataFrame:
    """The second and later rows (by rowid) of a name get .001, .002 and so on."""
    k = F.row_number().over(Window.partitionBy("name").orderBy("rowid")) - 1
    return df.withColumn("name", F.when(k > 0, F.concat("name", F.lit("."), F.lpad(k.cast("string"), width, "0"))).otherwise(F.col("name")))


def tiled(df: DataFrame, window: int, step: int) -> DataFrame:
    """Windows of each interval; a rest of more than half a window is a window of its own, else it joins the last."""
    n = F.col("end") - F.col("start")
    starts = F.when(n > window, F.sequence(F.lit(0).cast("bigint"), n - window, F.lit(step).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = df.select("*", F.posexplode(starts).alias("_k", "_s"), F.size(starts).alias("_m"))
    rest = n - F.col("_s") - window
    last = F.col("_k") == F.col("_m") - 1
    upto = F.when(last & (rest > 0) & (rest <= window / 2), n).otherwise(F.least(F.col("_s") + window, n))
    own = F.array(F.struct(F.col("_s").alias("a"), upto.alias("b")))
    more = F.when(last & (rest > window / 2), F.array(F.struct((F.col("_s") + window).alias("a"), n.alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    out = rows.select(*df.columns, F.explode(F.concat(own, more)).alias("_w"))
    return out.withColumns({"end": F.col("start") + F.col("_w.b"), "start": F.col("start") + F.col("_w.a")}).drop("_w")


def near_first(df: DataFrame, target: DataFrame, most: int) -> DataFrame:
    """Rows on the chromosome of the target's first row, of which an end lies within most of one of its ends."""
    t = target.orderBy("rowid").limit(1).select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    gap = F.least(*[F.abs(F.col(x) - F.col(y)) for x in ("start", "end") for y in ("_s", "_e")])
    return df.join(F.broadcast(t), F.col("chrom") == F.col("_c")).withColumn("distance", gap).where(F.col("distance") <= most).drop("_c", "_s", "_e")


def spanning(starts: DataFrame, ends: DataFrame, least: int, most: int, strands: str = "opposite") -> DataFrame:
    """Regions from an interval of starts to one of ends further on, of a length in [least, most].

    The ends are listed in the bins that such a region can reach, so that the range join is one of equality.
    """
    width = max(most, 1)
    a = starts.where("chrom is not null").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + most) / width))))
    b = suffixed(ends.where("chrom is not null"), "_b").withColumn("_bin_b", F.floor(F.col("end_b") / width))
    size = F.col("end_b") - F.col("start")
    on = (F.col("chrom") == F.col("chrom_b")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("start_b") >= F.col("start")) & size.between(least, most)
    if strands != "any":
        on = on & ((F.col("strand") == F.col("strand_b")) if strands == "same" else (F.col("strand") != F.col("strand_b")))
    return a.join(b, on).select("chrom", "start", F.col("end_b").alias("end"), F.col("name").alias("name_a"), "name_b", size.alias("length"))


def merged(df: DataFrame, by_strand: bool = False, width: int = 1 << 16) -> DataFrame:
    """(chrom, start, end, records): overlapping and touching intervals united.

    Within a bin by a running maximum; what came before a bin is the running maximum over the bins'
    own maxima, a table of one row a bin.
    """
    keys = ["chrom", "strand"] if by_strand else ["chrom"]
    rows = df.where("chrom is not null and start < end").withColumn("_bin", F.floor(F.col("start") / width))
    tops = rows.groupBy(*keys, "_bin").agg(F.max("end").alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    order = Window.partitionBy(*keys, "_bin").orderBy("start", "end")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    marked = rows.join(before, [*keys, "_bin"]).withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = marked.withColumn("_island", island).groupBy(*keys, "_bin", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("records"), F.max("_new").alias("_new"))
    whole = F.sum("_new").over(Window.partitionBy(*keys).orderBy("_bin", "_island").rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_whole", whole).groupBy(*keys, "_whole").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("records").alias("records")).drop("_whole")


def coverage_steps(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(…, start, end, depth): maximal stretches of equal depth, by sums of +1 and -1 at the bounds."""
    keys = keys or ["chrom"]
    bounds = df.where("chrom is not null and start < end").select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    sums = bounds.groupBy(*keys, "x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*keys).orderBy("at")
    return sums.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth")).where("end is not null and depth > 0")


def best_covered(df: DataFrame) -> DataFrame:
    """(chrom, start, end, depth): from the first to the last position of the greatest depth of each chromosome."""
    steps = coverage_steps(df)
    top = steps.groupBy("chrom").agg(F.max("depth").alias("depth"))
    return steps.join(top, ["chrom", "depth"]).groupBy("chrom", "depth").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def counts_in(regions: DataFrame, items: DataFrame, pivot: str | None = None, values: list | None = None, bases: bool = False, key: str = "rowid") -> DataFrame:
    """Overlapping items (or their shared positions) of each region; zero where there are none; one column a value of pivot."""
    pairs = overlapping(regions.select(key, "chrom", "start", "end"), items)
    what = F.sum("shared") if bases else F.count(F.lit(1))
    if pivot:
        found = pairs.groupBy(key).pivot(f"{pivot}_b", values).agg(what)
        names = [c for c in found.columns if c != key]
    else:
        found, names = pairs.groupBy(key).agg(what.alias("n")), ["n"]
    return regions.select(key).join(found, key, "left").select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])


def windows_over(lengths: DataFrame, window: int, step: int) -> DataFrame:
    """(chrom, start, end): windows of fixed size that end before the chromosome does."""
    rows = lengths.where(F.col("length") > window)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - window - 1, F.lit(step).cast("bigint"))
    return rows.select("chrom", F.explode(starts).alias("start")).withColumn("end", F.col("start") + window)


def covered_windows(lengths: DataFrame, items: DataFrame, source: str, sources: int, window: int, step: int, least: int) -> DataFrame:
    """Windows in which every source has at least so many items; coverage is the least of the sources'."""
    wins = windows_over(lengths, window, step)
    each = overlapping(wins, items).groupBy("chrom", "start", "end", f"{source}_b").agg(F.count("*").alias("n"))
    return each.where(F.col("n") >= least).groupBy("chrom", "start", "end").agg(F.count("*").alias("k"), F.min("n").alias("coverage")).where(F.col("k") == sources).drop("k")


def refined(regions: DataFrame, items: DataFrame, key: str = "rowid") -> DataFrame:
    """Regions cut to the least start and greatest end of their items, and the share of reverse ones."""
    pairs = overlapping(regions, items)
    return pairs.groupBy(key, "chrom").agg(F.greatest(F.first("start"), F.min("start_b")).alias("start"), F.least(F.first("end"), F.max("end_b")).alias("end"), F.avg((F.col("strand_b") == "-").cast("double")).alias("reverse_share"))


def reoriented(regions: DataFrame, items: DataFrame, key: str = "rowid") -> DataFrame:
    """strand: - if more than half of the items are reverse, else +."""
    share = overlapping(regions, items).groupBy(key).agg(F.avg((F.col("strand_b") == "-").cast("double")).alias("_r"))
    return regions.join(share, key, "left").withColumn("strand", F.when(F.col("_r") > 0.5, "-").otherwise("+")).drop("_r")


def extreme_per_chrom(df: DataFrame, last: bool = False) -> DataFrame:
    """The first or last region of each chromosome; the longer one, then the least rowid on ties."""
    s = F.col("start") if last else -F.col("start")
    best = df.groupBy("chrom").agg(F.max(F.struct(s.alias("s"), "end", (-F.col("rowid")).alias("r"))).alias("b"))
    return best.select("chrom", (F.col("b.s") if last else -F.col("b.s")).alias("start"), F.col("b.end").alias("end"), (-F.col("b.r")).alias("rowid"))


def to_chrom_end(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """end: the chromosome's length; an error for a chromosome without one."""
    known = small_or_plain(lengths.select("chrom", F.col("length").alias("_l")))
    return df.join(known, "chrom", "left").withColumn("end", F.when(F.col("_l").isNull(), F.raise_error(F.concat(F.lit("no length of "), "chrom"))).otherwise(F.col("_l"))).drop("_l")


def chroms_renamed(df: DataFrame, key: DataFrame) -> DataFrame:
    """chrom by a table (old, new); an error for one that it lacks."""
    names = small_or_plain(key.select(F.col("old").alias("chrom"), F.col("new").alias("_n")))
    return df.join(names, "chrom", "left").withColumn("chrom", F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no name for "), "chrom"))).otherwise(F.col("_n"))).drop("_n")


def sequences_of(df: DataFrame, genome: DataFrame) -> DataFrame:
    """seq: the region's letters, reverse-complemented on strand -; null where the chromosome is unknown."""
    both = df.join(genome.select("chrom", F.col("seq").alias("_s")), "chrom", "left")
    part = F.expr("substring(_s, int(start + 1), int(end - start))")
    return both.withColumn("seq", F.when(_minus(), S.reverse_complement(part)).otherwise(part)).drop("_s")


def _greedy(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """Order-dependent scans run per cluster of overlapping intervals: what one takes never depends on another.

    fn gets a cluster's columns as arrays and gives rows. A task reads its clusters one after the
    other from sorted partitions.
    """
    islands = merged(df).select("chrom", "start", "end")
    placed = overlapping(df, islands, suffix="_m").select("chrom", "start_m", *columns).repartition("chrom", "start_m").sortWithinPartitions("chrom", "start_m")

    def scan(batches):
        import numpy as np
        import pandas as pd

        def solve(pdf):
            new = (pdf["chrom"].to_numpy()[1:] != pdf["chrom"].to_numpy()[:-1]) | (pdf["start_m"].to_numpy()[1:] != pdf["start_m"].to_numpy()[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)]
            chrom, arrays = pdf["chrom"].to_numpy(), [pdf[c].to_numpy() for c in columns]
            return [(chrom[a], *row) for a, b in zip(cuts, cuts[1:], strict=False) for row in fn(*[x[a:b] for x in arrays])]

        names = [x.split()[0] for x in schema.split(", ")]
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (held["chrom"] == held["chrom"].iloc[-1]) & (held["start_m"] == held["start_m"].iloc[-1])
            n = int((~last).sum())
            if n:
                yield pd.DataFrame(solve(held.iloc[:n]), columns=names)
                held = held.iloc[n:]
        if held is not None and len(held):
            yield pd.DataFrame(solve(held), columns=names)

    return placed.mapInPandas(scan, schema)


def best_non_overlapping(df: DataFrame, allowed: int = 0, highest: bool = True, top: int | None = None) -> DataFrame:
    """Greedy choice by score (then rowid): a region is taken if it shares at most `allowed` positions with each taken one.

    Regions that don't overlap can't exclude each other, so each cluster of overlapping regions is
    scanned alone; a top list is taken over all of them afterwards, which gives the same rows.
    """

    def choose(start, end, name, score, rowid):
        import bisect

        order = sorted(range(len(start)), key=lambda k: (-score[k] if highest else score[k], rowid[k]))
        taken: list[tuple[int, int]] = []
        longest = 0
        for k in order:
            a, b = int(start[k]), int(end[k])
            at = bisect.bisect_left(taken, (a - longest, 0))
            while at < len(taken) and taken[at][0] < b:
                if min(b, taken[at][1]) - max(a, taken[at][0]) > allowed:
                    break
                at += 1
            else:
                bisect.insort(taken, (a, b))
                longest = max(longest, b - a)
                yield a, b, name[k], float(score[k]), int(rowid[k])

    found = _greedy(df, ["start", "end", "name", "score", "rowid"], choose, "chrom string, start bigint, end bigint, name string, score double, rowid bigint")
    return found if top is None else found.orderBy(F.desc("score") if highest else F.asc("score"), "rowid").limit(top)


def plot_rows(df: DataFrame) -> DataFrame:
    """row: the lowest row that no earlier overlapping region (by start, end, rowid) occupies."""

    def rows(start, end, name, rowid):
        import heapq

        free: list[int] = []
        busy: list[tuple[int, int]] = []
        used = 0
        for k in sorted(range(len(start)), key=lambda k: (start[k], end[k], rowid[k])):
            a, b = int(start[k]), int(end[k])
            while busy and busy[0][0] <= a:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                row = heapq.heappop(free)
            else:
                row, used = used, used + 1
            heapq.heappush(busy, (b, row))
            yield a, b, name[k], int(rowid[k]), row

    return _greedy(df, ["start", "end", "name", "rowid"], rows, "chrom string, start bigint, end bigint, name string, rowid bigint, row int")
