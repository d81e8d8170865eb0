"""Operators over reads: DataFrames with rowid, name, seq and optionally qual, cnt, meta.

Each is a narrow projection or filter; further columns pass through. Null sequences give null results
and are excluded by filters; empty ones are of length 0. Operators that split a table in two add a
boolean column, so that one pass serves both outputs (partitionBy at the sink).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.runtime import small_or_plain



def clipped(df: DataFrame, start: Column | int, size: Column | int) -> DataFrame:
    """seq and qual from 0-based start on, at most size letters."""
    a, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, size))
    a, n = F.greatest(a, F.lit(0)), F.greatest(n, F.lit(0))
    df = df.withColumns({"_a": a.cast("int"), "_n": n.cast("int")}).withColumn("seq", F.when(F.col("_n") > 0, F.substring(F.col("seq"), F.col("_a") + 1, F.col("_n"))).when(F.col("seq").isNotNull(), F.lit("")))
    if "qual" in df.columns:
        df = df.withColumn("qual", F.slice(F.col("qual"), F.col("_a") + 1, F.col("_n")))
    return df.drop("_a", "_n")


# --- trimming


def trim_front(df: DataFrame, n: int) -> DataFrame:
    return clipped(df, n, F.length(F.col("seq")) - n)


def trim_end(df: DataFrame, n: int) -> DataFrame:
    return clipped(df, 0, F.length(F.col("seq")) - n)


def trim_edges(df: DataFrame, front: int, end: int) -> DataFrame:
    return clipped(df, front, F.length(F.col("seq")) - front - end)


def trim_to_length(df: DataFrame, n: int) -> DataFrame:
    """At most n letters; column on tells whether the read was long enough."""
    return clipped(df.withColumn("on", F.length(F.col("seq")) >= n), 0, n)


def trim_to_positions(df: DataFrame, start: int, end: int) -> DataFrame:
    """Letters [start, end); on is false for reads that end before."""
    return clipped(df.withColumn("on", F.length(F.col("seq")) >= end), start, end - start)


def trim_to_named_positions(df: DataFrame, positions: DataFrame, only_listed: bool = True) -> DataFrame:
    """Each read once for every (name, start, end) of its name, or whole if it has none and only_listed is off."""
    marks = small_or_plain(positions.select("name", F.col("start").alias("_start"), F.col("end").alias("_end")))
    both = df.join(marks, "name", "inner" if only_listed else "left")
    return clipped(both, F.coalesce("_start", F.lit(0)), F.coalesce(F.col("_end") - F.col("_start"), F.length(F.col("seq")))).drop("_start", "_end")


def trim_at_first(df: DataFrame, base: str) -> DataFrame:
    """Up to the first occurrence of base, exclusive; whole without one."""
    at = F.instr(F.col("seq"), F.lit(base))
    return clipped(df, 0, F.when(at > 0, at - 1).otherwise(F.length(F.col("seq"))))


def trim_at_last(df: DataFrame, base: str) -> DataFrame:
    at = F.instr(F.reverse(F.col("seq")), F.lit(base))
    return clipped(df, 0, F.when(at > 0, F.length(F.col("seq")) - at).otherwise(F.length(F.col("seq"))))


def trim_at_first_quality(df: DataFrame, most: int) -> DataFrame:
    """Up to the first quality of at most this, exclusive."""
    at = F.array_position(F.transform(F.col("qual"), lambda q: (q <= most).cast("int")), 1)
    return clipped(df, 0, F.when(at > 0, at - 1).otherwise(F.length(F.col("seq"))))


def strip_base(df: DataFrame, left: str = "", right: str = "") -> DataFrame:
    """Without the runs of these bases at the ends."""
    a = F.length(F.regexp_extract(F.col("seq"), f"^{left}*", 0)) if left else F.lit(0)
    b = F.length(F.regexp_extract(F.col("seq"), f"{right}*$", 0)) if right else F.lit(0)
    return clipped(df, a, F.length(F.col("seq")) - a - b)


def strip_quality(df: DataFrame, left: int | None = None, right: int | None = None) -> DataFrame:
    """Without the leading and trailing letters of lower quality than these."""
    n = F.size(F.col("qual"))

    def lead(values: Column, least: int | None) -> Column:
        if least is None:
            return F.lit(0)
        at = F.array_position(F.transform(values, lambda q: (q >= least).cast("int")), 1)
        return F.when(at > 0, at - 1).otherwise(n)

    a, b = lead(F.col("qual"), left), lead(F.reverse(F.col("qual")), right)
    return clipped(df, a, n - a - b)


def trim_sliding_quality(df: DataFrame, size: int = 10, step: int = 5, threshold: float = 20.0, streak: int = 3) -> DataFrame:
    """Cut where so many windows in a row have a mean of at most the threshold, at the first of these."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(-1).alias("first"), F.lit(-1).alias("cut"))

    def step_on(acc: Column, w: Column) -> Column:
        bad = w["mean"] <= threshold
        run = F.when(bad, acc["run"] + 1).otherwise(F.lit(0))
        first = F.when(bad & (acc["run"] == 0), w["pos"]).otherwise(acc["first"])
        return F.struct(run.alias("run"), first.alias("first"), F.when((acc["cut"] < 0) & (run >= streak), first).otherwise(acc["cut"]).alias("cut"))

    cut = F.aggregate(S.window_means(F.col("qual"), size, step), zero, step_on, lambda a: a["cut"])
    return clipped(df, 0, F.when(cut >= 0, cut).otherwise(F.length(F.col("seq"))))


def break_at_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """One row per non-empty part between matches: part, start, end (0-based) on the read."""
    parts = F.split(F.col("seq"), f"(?={pattern})|(?<={pattern})")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("all"))

    def add(acc: Column, t: Column) -> Column:
        return F.struct((acc["at"] + F.length(t)).alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("start"), t.alias("text")))).alias("all"))

    placed = F.filter(F.aggregate(parts, zero, add, lambda a: a["all"]), lambda x: (F.length(x["text"]) > 0) & ~x["text"].rlike(f"^(?:{pattern})$"))
    rows = df.select("*", F.posexplode(placed).alias("part", "_x"))
    return rows.withColumns({"start": F.col("_x.start"), "end": F.col("_x.start") + F.length("_x.text"), "seq": F.col("_x.text")}).drop("_x")


# --- changing


def remove_low_quality(df: DataFrame, most: int) -> DataFrame:
    """Without the letters of quality at most this."""
    kept = F.filter(F.arrays_zip(S.letters(F.col("seq")).alias("l"), F.col("qual").alias("q")), lambda x: x["q"] > most)
    return df.withColumn("_k", kept).withColumns({"seq": F.array_join(F.transform("_k", lambda x: x["l"]), ""), "qual": F.transform("_k", lambda x: x["q"])}).drop("_k")


def raise_quality(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("qual", F.transform(F.col("qual"), lambda q: q + by))


def reverse_complemented(df: DataFrame, mark: bool = False) -> DataFrame:
    out = df.withColumn("seq", S.reverse_complement(F.col("seq")))
    out = out.withColumn("qual", F.reverse(F.col("qual"))) if "qual" in df.columns else out
    return out.withColumn("name", F.concat("name", F.lit("_Comp"))) if mark else out


def change_case(df: DataFrame, position: int = 0, size: int | None = None, back: bool = False, how: str = "lower") -> DataFrame:
    """Lower, upper or swapped case of a part of the sequence, counted from the front or the back."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n = F.length(F.col("seq"))
    length = n if size is None else F.least(F.lit(size), n - position)
    start = n - position - length if back else F.lit(position)
    part = F.substring(F.col("seq"), start + 1, length)
    changed = {"lower": F.lower, "upper": F.upper, "swap": lambda c: F.translate(c, lower + upper, upper + lower)}[how](part)
    whole = F.concat(F.substring(F.col("seq"), F.lit(1), start), changed, F.substring(F.col("seq"), start + length + 1, n))
    return df.withColumn("seq", F.when(length > 0, whole).otherwise(F.col("seq")))


def add_sequence(df: DataFrame, motif: str, front: bool = False) -> DataFrame:
    """One row per form of a motif (IUPAC) that is appended or prepended."""
    forms = F.explode(F.array(*[F.lit(f) for f in S.degenerate_forms(motif)]))
    out = df.select("*", forms.alias("_f"))
    return out.withColumn("seq", F.concat("_f", "seq") if front else F.concat("seq", "_f")).drop("_f")


def longest_protein(df: DataFrame) -> DataFrame:
    """protein: the longest stretch without a stop in three frames (first frame on ties), and its frame."""

    def stretches(frame: int) -> Column:
        return F.transform(F.split(S.translated(F.col("seq"), frame), r"\*"), lambda p: F.struct(F.length(p).alias("n"), F.lit(-frame).alias("order"), p.alias("protein")))

    frames = F.array(*[stretches(frame) for frame in range(3)])
    best = F.array_max(F.flatten(frames))
    return df.withColumn("_b", best).withColumns({"protein": F.col("_b.protein"), "frame": -F.col("_b.order")}).drop("_b")


def open_frame(df: DataFrame) -> DataFrame:
    """protein and frame of the first frame without a stop inside; null if there is none."""
    found = F.coalesce(*[F.when(~F.regexp_replace(S.translated(F.col("seq"), f), r"\*$", "").contains("*"), F.struct(S.translated(F.col("seq"), f).alias("protein"), F.lit(f).alias("frame"))) for f in range(3)])
    return df.withColumn("_b", found).withColumns({"protein": F.col("_b.protein"), "frame": F.col("_b.frame")}).drop("_b")


def renamed(df: DataFrame, stub: str, width: int = 6) -> DataFrame:
    """Names stub.number in the order of rowid, without one global sort task."""
    out = numbered(df).withColumn("old_name", F.col("name"))
    return out.withColumn("name", F.concat(F.lit(stub + "."), F.lpad(F.col("_number").cast("string"), width, "0"))).drop("_number")


def in_chunks(df: DataFrame, size: int) -> DataFrame:
    """With column chunk: files of so many reads each, in the order of rowid."""
    return numbered(df).withColumn("chunk", F.floor(F.col("_number") / size)).drop("_number")


def numbered(df: DataFrame) -> DataFrame:
    """With _number from 0 in the order of rowid: numbers within range partitions, plus the count of the partitions before."""
    placed = df.repartitionByRange("rowid").sortWithinPartitions("rowid").withColumn("_p", F.spark_partition_id())
    from seqloom.runtime import written

    placed = written(placed, "ranged")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_p").orderBy("rowid")) + F.col("_before") - 1
    return placed.join(F.broadcast(before), "_p").withColumn("_number", number).drop("_p", "_before")


def replicated(df: DataFrame) -> DataFrame:
    """Each read round(cnt) times, at least never for a count below a half; copy counts from 0."""
    times = F.coalesce(F.round("cnt").cast("int"), F.lit(1))
    return df.where(times > 0).select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")).withColumns({"name": F.concat("name", F.lit("_"), "copy"), "cnt": F.lit(1.0)})


# --- collapsing


def collapsed(df: DataFrame, by: list[str] | None = None, names: bool = False) -> DataFrame:
    """One row per distinct sequence (and further keys): its first rowid, number of records and summed cnt.

    names: with the sorted names of all members; for groups without bound leave it off and use members().
    """
    more = [F.array_sort(F.collect_list("name")).alias("names")] if names else []
    return df.where(F.col("seq").isNotNull()).groupBy(*(by or []), "seq").agg(F.min("rowid").alias("rowid"), F.count("*").alias("records"), F.sum("cnt").alias("cnt"), *more)


def members(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(rep, rowid, name): each record with the first rowid of its sequence, of any number of copies."""
    keys = [*(by or []), "seq"]
    first = df.where(F.col("seq").isNotNull()).groupBy(*keys).agg(F.min("rowid").alias("rep"))
    return df.join(first, keys).select("rep", "rowid", "name")


def uncollapsed(df: DataFrame, member_list: DataFrame) -> DataFrame:
    """Undo collapsed(): one row per member with the representative's sequence."""
    return df.select(F.col("rowid").alias("rep"), "seq").join(member_list, "rep").select("rowid", "name", "seq")


# --- splitting and choosing


def flag_length(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    n = F.length(F.col("seq"))
    ok = F.lit(True)
    if least is not None:
        ok = ok & (n >= least)
    if most is not None:
        ok = ok & (n <= most)
    return df.withColumn("include", F.coalesce(ok, F.lit(False)))


def flag_contains(df: DataFrame, motif: str, occurrences: int = 1) -> DataFrame:
    """include: fewer than so many (overlapping) occurrences of motif."""
    return df.withColumn("include", F.coalesce(F.regexp_count(F.col("seq"), F.lit(f"(?={motif})")) < occurrences, F.lit(False)))


def flag_name(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("include", ~F.coalesce(F.col("name").contains(text), F.lit(False)))


def flag_quality_windows(df: DataFrame, size: int, step: int, threshold: float) -> DataFrame:
    """include: no window's mean quality is below the threshold; reads without quality are excluded."""
    return df.withColumn("include", F.coalesce(~F.exists(S.window_means(F.col("qual"), size, step), lambda w: w["mean"] < threshold), F.lit(False)))


def composition_distance(df: DataFrame) -> DataFrame:
    """distance: summed differences of a read's letter fractions (A, C, G, T) from all reads'."""
    parts = {b: S.count_of(F.col("seq"), b) for b in "ACGT"}
    totals = df.agg(*[F.sum(c).alias(f"_t{b}") for b, c in parts.items()])
    all_of = sum((F.col(f"_t{b}") for b in "CGT"), F.col("_tA"))
    n = S.count_of(F.col("seq"), "ACGT")
    gaps = [F.abs(c / n - F.col(f"_t{b}") / all_of) for b, c in parts.items()]
    return df.join(F.broadcast(totals)).withColumn("distance", F.when(n > 0, sum(gaps[1:], gaps[0]))).drop(*[f"_t{b}" for b in "ACGT"])


def flag_composition(df: DataFrame) -> DataFrame:
    """include: the distance of composition is at most the mean plus two standard deviations."""
    far = composition_distance(df)
    bound = far.agg((F.avg("distance") + 2 * F.stddev_samp("distance")).alias("_bound"))
    return far.join(F.broadcast(bound)).withColumn("include", F.coalesce(F.col("distance") <= F.col("_bound"), F.lit(False))).drop("_bound")


def starting_with(df: DataFrame, motif: str, errors: int = 0) -> DataFrame:
    return df.where(S.mismatches_at(F.col("seq"), motif, F.lit(1)) <= errors)


def ending_with(df: DataFrame, motif: str, errors: int = 0) -> DataFrame:
    return df.where((F.length(F.col("seq")) >= len(motif)) & (S.mismatches_at(F.col("seq"), motif, F.length(F.col("seq")) - len(motif) + 1) <= errors))


def by_name(df: DataFrame, names: DataFrame, excluding: bool = False) -> DataFrame:
    return df.join(small_or_plain(names.select("name").where("name is not null").distinct()), "name", "left_anti" if excluding else "left_semi")


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n reads without replacement: those with the least seeded hash, the same on any cluster."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), "rowid")).orderBy("_h", "rowid").limit(n).drop("_h")


def balanced(df: DataFrame, group: Column, seed: int) -> DataFrame:
    """Every group cut to the size of the smallest, by seeded hash."""
    df = df.withColumn("_g", group)
    least = df.groupBy("_g").count().agg(F.min("count").alias("_least"))
    order = Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(seed), "rowid"), "rowid")
    return df.withColumn("_r", F.row_number().over(order)).join(F.broadcast(least)).where("_r <= _least").drop("_g", "_r", "_least")


def demultiplexed(df: DataFrame, barcodes: DataFrame, errors: int = 0, most_barcodes: int = 10_000) -> DataFrame:
    """(…, barcode_id, reverse): the barcode that a read starts with, or its reverse complement does.

    barcodes: (id, barcode). With errors each barcode is listed with its variants, so that the join
    stays one of equality; the least (errors, id) wins. Reads without one have nulls.
    """
    listed = barcodes.where("barcode is not null").select(F.col("id").alias("barcode_id"), F.upper("barcode").alias("barcode"))
    forms = listed.withColumn("wrong", F.lit(0))
    for k in range(errors):
        spots = F.sequence(F.lit(1), F.length("barcode"))
        other = F.explode(F.flatten(F.transform(spots, lambda i: F.transform(F.array(*[F.lit(x) for x in "ACGTN"]), lambda x: F.overlay("barcode", x, i, F.lit(1))))))
        forms = forms.unionByName(forms.where(F.col("wrong") == k).select("barcode_id", other.alias("barcode"), F.lit(k + 1).alias("wrong")))
    forms = forms.groupBy("barcode").agg(F.min(F.struct("wrong", "barcode_id")).alias("hit"))
    sizes = [r[0] for r in forms.select(F.length("barcode")).distinct().limit(most_barcodes).collect()]
    both = df.select("*", F.explode(F.array(F.struct(F.lit(False).alias("reverse"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("reverse"), S.reverse_complement(F.col("seq")).alias("s")))).alias("_o"))
    tries = both.select("rowid", "_o.reverse", F.explode(F.array(*[F.struct(F.substring("_o.s", 1, n).alias("barcode")) for n in sizes])).alias("_t")).select("rowid", "reverse", "_t.barcode")
    best = tries.join(small_or_plain(forms), "barcode").groupBy("rowid").agg(F.min(F.struct("hit.wrong", "reverse", "hit.barcode_id")).alias("b"))
    return df.join(best, "rowid", "left").withColumns({"barcode_id": F.col("b.barcode_id"), "reverse": F.col("b.reverse")}).drop("b")
