"""Contigs longer than a limit, cut into overlapping pieces at runs of N.

A cut is a position between two letters; its piece ends there, and the next piece starts `overlap`
letters before it. From a cut c the next cut lies in (c, c + advance], with advance = limit - overlap,
so the first one is found as if cut `overlap` stood before the contig. The farthest legal cut inside a
run of N in that reach is taken, else c + advance.

Boundaries are all positions inside runs of N (in a run of one N, the position after it), the start
and the end. Every boundary is joined to its farthest legal successor: equal steps of `advance` lead
to the reach that holds the next boundary, then the last boundary of that reach is the successor, and
the steps count as plain cuts of that edge. Pointer doubling squares the successor table: after k
rounds it jumps 2^k edges, and the boundaries reached from the start are doubled each round. So the
greedy cuts of a contig of n boundaries take log2(n) array operations instead of a walk.

Each contig's runs of N are found where its text is read, a contig at a time, so a contig must fit into a task. No
contig is shuffled: the table of runs is broadcast if it is shown to be small, and joined by file
name otherwise.

Defined results: letters are A-Z in any case, nothing else counts; a null file name joins nothing; a
null or empty text has no letters and gives no piece; a null limit or step is the default (100, 10);
limits below 1 count as 1 for the pieces; an overlap that would leave no advance is cut to limit - 1;
steps larger than the limit give no overlap; a contig of at most the limit gives no piece; repeated
rows of either table give repeated pieces; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import small_or_plain

DEFAULT_LENGTH, DEFAULT_STEP = 100, 10
#: Pieces sent in one batch.
ROWS = 2000


def runs_of_n(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of N in an array of letters (bytes, any case)."""
    is_n = np.concatenate(([0], ((letters | 32) == ord("n")).view(np.int8), [0]))
    edges = np.diff(is_n)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def only_letters(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    low = raw | 32
    return raw[(raw < 128) & (low >= 97) & (low <= 122)]


def cuts(length: int, starts: np.ndarray, ends: np.ndarray, limit: int, step: int) -> tuple[np.ndarray, int]:
    """The cuts of a contig, its end included, and the overlap. See the module's text."""
    limit = max(1, limit)
    overlap = min(max(0, limit - step), limit - 1)
    advance = limit - overlap
    first, last = np.where(ends - starts > 1, starts + 1, ends), np.where(ends - starts > 1, ends - 1, ends)
    sizes = last - first + 1
    inside = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(starts) else np.zeros(0, np.int64)
    marks = np.concatenate(([overlap], inside[(inside > overlap) & (inside < length)], [length])).astype(np.int64)
    n = len(marks)
    following = np.minimum(np.arange(n) + 1, n - 1)
    plain = np.maximum((marks[following] - marks + advance - 1) // advance - 1, 0)  # steps before the reach that holds it
    reach = marks + (plain + 1) * advance
    jump = np.searchsorted(marks, reach, side="right") - 1  # the farthest legal successor
    jump[-1] = n - 1
    edge = jump.copy()
    reached, far = np.zeros(1, np.int64), jump
    while reached[-1] != n - 1:
        more = far[reached]
        reached = np.unique(np.concatenate((reached, more)))
        far = far[far]
    path = reached[:-1]
    n_plain = plain[path]
    plain_cuts = np.repeat(marks[path], n_plain) + advance * (np.arange(n_plain.sum()) - np.repeat(np.cumsum(n_plain) - n_plain, n_plain) + 1)
    return np.sort(np.concatenate((plain_cuts, marks[edge[path]]))), overlap


def contig_runs(genome: DataFrame, file: str = "genome_fnp", chrom: str = "chrom", seq: str = "seq") -> DataFrame:
    """(file, chrom, letters, n_starts, n_ends) of each contig."""

    @F.pandas_udf("struct<letters: bigint, n_starts: array<bigint>, n_ends: array<bigint>>")
    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            letters = only_letters(t or "")
            a, b = runs_of_n(letters)
            rows.append((len(letters), a.astype(np.int64), b.astype(np.int64)))
        return pd.DataFrame(rows, columns=["letters", "n_starts", "n_ends"])

    return genome.where(F.col(file).isNotNull()).select(file, chrom, spans(F.col(seq)).alias("s")).select(file, chrom, "s.*")


def pieces(genome: DataFrame, pars: DataFrame, file: str = "genome_fnp", chrom: str = "chrom", seq: str = "seq", with_text: bool = False) -> DataFrame:
    """(pars_id, chrom, piece, start, end, at_n[, text]) of every contig longer than a run's limit.

    start and end count letters from 0, end exclusive; at_n tells whether the piece's end is inside a run of N.
    With text, a contig's row meets the runs of its file and is cut where it is read; without, only its runs of N do.
    """
    runs = pars.where(F.col(file).isNotNull()).select(file, "pars_id", F.coalesce("window_length", F.lit(DEFAULT_LENGTH)).cast("bigint").alias("limit"), F.coalesce("window_step", F.lit(DEFAULT_STEP)).cast("bigint").alias("step"))
    source = genome.where(F.col(file).isNotNull()).select(file, chrom, F.col(seq).alias("seq")) if with_text else contig_runs(genome, file, chrom, seq)
    long = source.join(small_or_plain(runs), file).where(F.length("seq") > F.col("limit") if with_text else F.col("letters") > F.col("limit"))
    what = ["seq"] if with_text else ["letters", "n_starts", "n_ends"]
    names = ["pars_id", chrom, "piece", "start", "end", "at_n", *(["text"] if with_text else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run, name, most, by = (batch.column(c)[k].as_py() for c in range(4))
                if with_text:
                    text = only_letters(batch.column(4)[k].as_py())
                    size, (a, b) = len(text), runs_of_n(text)
                    if size <= most:
                        continue
                else:
                    size, a, b = batch.column(4)[k].as_py(), *(batch.column(c)[k].values.to_numpy() for c in (5, 6))
                ends, overlap = cuts(size, a, b, most, by)
                begins = np.concatenate(([0], ends[:-1] - overlap))
                at = np.searchsorted(a, ends, side="left") - 1
                at_n = (at >= 0) & (ends <= (b[np.maximum(at, 0)] if len(b) else 0)) & (ends < size)
                for first in range(0, len(ends), ROWS):
                    x, y = begins[first : first + ROWS], ends[first : first + ROWS]
                    n = len(x)
                    columns = [pa.array([run] * n, pa.int64()), pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(x), pa.array(y), pa.array(at_n[first : first + ROWS])]
                    if with_text:
                        columns.append(pa.array([text[i:j].tobytes() for i, j in zip(x.tolist(), y.tolist(), strict=True)], pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"pars_id bigint, `{chrom}` string, piece int, start bigint, `end` bigint, at_n boolean" + ", text string" * with_text
    return long.select("pars_id", chrom, "limit", "step", *what).mapInArrow(cut, schema)
