"""Finding one sequence in many: the best place of a target in each read, and what is cut by it.

The target is aligned whole, the read in part, with affine gaps. All reads of a batch go through the
matrix together, a row of it for each letter of the target; a cell's number holds the score and, below
it, the columns, the matches and the start of its best path, so no path is traced back. Reads are not
shuffled, and a batch is bounded by its letters.

Defined results: a null read or target gives nulls; a read without letters has no place; of equal scores
the path of more columns, then matches, then the later start is taken, and the first end; columns of
the table stay. A target has at most 2,000 letters, a read fewer than 2**20; longer ones are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S

MATCH, MISMATCH, OPEN, EXTEND = 2, -2, 5, 1
MOST_TARGET, MOST_READ = 2000, 1 << 20
_START, _MATCHES, _COLUMNS = 20, 11, 12
_SCORE = _START + _MATCHES + _COLUMNS
PLACE = "struct<score: int, start: int, end: int, matches: int, columns: int>"


def places_in(texts: list[str], target: str) -> list[tuple[int, int, int, int, int] | None]:
    """(score, start, end, matches, columns) of the target's best place in each text."""
    if len(target) > MOST_TARGET or max(map(len, texts), default=0) >= MOST_READ:
        raise ValueError("target or read too long")
    n = np.array([len(t) for t in texts])
    wide = int(n.max(initial=0))
    x = np.zeros((len(texts), wide), np.uint32)
    for k, t in enumerate(texts):
        x[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    one = 1 << (_START + _MATCHES)  # a column
    gap = lambda k: -(k << _SCORE)
    columns = np.arange(wide + 1, dtype=np.int64)
    best = np.broadcast_to(columns, (len(texts), wide + 1)).copy()  # score 0, start at each letter
    low = np.int64(-(1 << 61))
    down = np.full_like(best, low)
    for letter in target:
        down = np.maximum(down + gap(EXTEND), best + gap(OPEN)) + one
        row = down.copy()
        equal = x == ord(letter)
        np.maximum(row[:, 1:], best[:, :-1] + one + np.where(equal, (MATCH << _SCORE) + (1 << _START), MISMATCH << _SCORE), out=row[:, 1:])
        # a gap to the left of k letters costs OPEN + EXTEND (k - 1) and has k columns
        lead = np.maximum.accumulate(row + columns * ((EXTEND << _SCORE) - one), axis=1)
        row[:, 1:] = np.maximum(row[:, 1:], lead[:, :-1] + gap(OPEN - EXTEND) - columns[1:] * ((EXTEND << _SCORE) - one))
        best = row
    best[columns > n[:, None]] = low
    end = best.argmax(axis=1)
    value = best[np.arange(len(texts)), end]
    score = value >> _SCORE
    rest = value - (score << _SCORE)
    found = zip(score.tolist(), (rest & ((1 << _START) - 1)).tolist(), end.tolist(), ((rest >> _START) & ((1 << _MATCHES) - 1)).tolist(), (rest >> (_START + _MATCHES)).tolist(), strict=True)
    return [None if size == 0 or not target else f for f, size in zip(found, n.tolist(), strict=True)]


def in_bounds(texts: list[str], cells: int = 3_000_000) -> Iterator[list[int]]:
    """Positions of texts of like length, as many as one call may hold."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * (len(texts[order[upto]]) + 1) <= cells:
            upto += 1
        yield order[at:upto]
        at = upto


def place(seq: Column, target: str) -> Column:
    @F.pandas_udf(PLACE)
    def find(seqs: pd.Series) -> pd.DataFrame:
        texts = [s if isinstance(s, str) else "" for s in seqs]
        out: list[tuple | None] = [None] * len(texts)
        for pick in in_bounds(texts):
            for k, found in zip(pick, places_in([texts[k] for k in pick], target), strict=True):
                out[k] = found
        return pd.DataFrame([f or (None,) * 5 for f in out], columns=["score", "start", "end", "matches", "columns"])

    return find(seq)


def located(df: DataFrame, target: str, both_strands: bool = False) -> DataFrame:
    """df with score, start, end, identity (matches a column), coverage (target letters matched) and reverse: the best place of the target; positions on the read as given."""
    seq = F.upper("seq")
    found = df.withColumn("_f", place(seq, target.upper()))
    if both_strands:
        turned = found.withColumn("_r", place(S.reverse_complement(seq), target.upper()))
        found = turned.withColumn("reverse", F.coalesce(F.col("_r.score") > F.col("_f.score"), F.lit(False)))
        p = F.when(F.col("reverse"), F.col("_r")).otherwise(F.col("_f"))
        size = F.length("seq")
        start, end = F.when(F.col("reverse"), size - p["end"]).otherwise(p["start"]), F.when(F.col("reverse"), size - p["start"]).otherwise(p["end"])
    else:
        found = found.withColumn("reverse", F.lit(False))
        p = F.col("_f")
        start, end = p["start"], p["end"]
    out = found.withColumns({"score": p["score"], "start": start, "end": end, "identity": p["matches"] / p["columns"], "coverage": p["matches"] / F.lit(max(1, len(target)))})
    return out.drop("_f", "_r")


def holding(df: DataFrame, target: str, identity: float = 0.8, coverage: float = 0.8, within: int | None = None, both_strands: bool = False) -> DataFrame:
    """Reads in which the target is found well enough, on request within so many letters of either end."""
    good = (F.col("identity") >= identity) & (F.col("coverage") >= coverage)
    if within is not None:
        good &= (F.col("start") <= within) | (F.length("seq") - F.col("end") <= within)
    return located(df, target, both_strands).where(good)


def _cut(df: DataFrame, found: DataFrame, part: Column, identity: float) -> DataFrame:
    on = F.coalesce(F.col("identity") >= identity, F.lit(False))
    return found.withColumn("on", on).withColumn("seq", F.when(F.col("on"), part).otherwise(F.col("seq"))).select(*df.columns, "on")


def trimmed_before(df: DataFrame, target: str, identity: float = 0.8, keep: bool = True) -> DataFrame:
    """Reads from the target on, or from its end on without keep; others as they are, with on = false."""
    return _cut(df, located(df, target), F.expr("substring(seq, start + 1)" if keep else "substring(seq, end + 1)"), identity)


def trimmed_from(df: DataFrame, target: str, identity: float = 0.8, keep: bool = True) -> DataFrame:
    """Reads up to the target, with keep up to its end."""
    return _cut(df, located(df, target), F.expr("substring(seq, 1, end)" if keep else "substring(seq, 1, start)"), identity)


def trimmed_between(df: DataFrame, front: str, back: str, identity: float = 0.8, keep: bool = True) -> DataFrame:
    """Reads from the first target to the second one; on is true where both are found in this order."""
    first = located(df, front).withColumnsRenamed({"start": "_a", "end": "_b", "identity": "_i"}).drop("score", "coverage", "reverse")
    both = located(first, back)
    low, high = (F.col("_a"), F.col("end")) if keep else (F.col("_b"), F.col("start"))
    on = F.coalesce((F.col("_i") >= identity) & (F.col("identity") >= identity) & (F.col("_b") <= F.col("start")), F.lit(False))
    part = F.substring("seq", low + 1, high - low)
    return both.withColumn("on", on).withColumn("seq", F.when(F.col("on"), part).otherwise(F.col("seq"))).select(*df.columns, "on")


def primer_pairs(df: DataFrame, forward: str, reverse: str, most: int, errors: int = 0, key: str = "chrom") -> DataFrame:
    """(id, start, end, strand, insert): places of a forward primer and a reverse one that face each other at most so far apart, ends included."""
    from seqloom.operators import kmers as K

    f, r = (K.motif_places(df, primer, errors, key=key) for primer in (forward, reverse))
    turned = F.when(F.col("strand") == "+", "-").otherwise("+")
    left = f.select("id", F.col("start").alias("fs"), F.col("end").alias("fe"), "strand", F.floor(F.col("start") / most).alias("_bin"))
    right = r.select("id", F.col("start").alias("rs"), F.col("end").alias("re"), turned.alias("strand"), F.explode(F.array(*[F.floor(F.col("start") / most) + k for k in (-1, 0, 1)])).alias("_bin"))
    pairs = left.join(right, ["id", "strand", "_bin"])
    start, end = F.least("fs", "rs"), F.greatest("fe", "re")
    facing = F.when(F.col("strand") == "+", F.col("fe") <= F.col("rs")).otherwise(F.col("re") <= F.col("fs"))
    return pairs.where(facing & (end - start <= most)).select("id", start.alias("start"), end.alias("end"), "strand", (end - start).alias("insert"))
