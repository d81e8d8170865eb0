"""Long exact spans shared between records, and chained fuzzy passages.

Exact spans. Every window of `least` letters has a seed: its k-mer of least hash among those in it. A
window that stands in two records has the same seed at the same place in both, so equal windows meet
at their seed. Consecutive windows with the same occurrence of a seed are a unit; a unit is sent with
its letters (2 bits each where they are A, C, G, T) to the task of its seed, an eighth of the volume
of all windows. There, windows of seeds that several records hold are compared by a 64-bit hash
(two different windows of one seed agree with probability 2**-64); those that stand in two records
come back as intervals, and a record's intervals are united. No pair of records is formed, so a span
that a third of all records share costs as much as any other.

Seeds that a sample shows to be hot (HOT records or more) go another way, which depends on no
group's size: their windows are counted by hash with partial aggregation (least and greatest record),
and the shared ones are joined back under a salt. The sample only chooses the way, not the result; at most
MOST_HOT seeds, the most frequent ones, are sent along.

Chaining gives pairs of passages with gaps, not the exact coverage, and needs pairs; so it is a second
operator, passages(), for the records with an id divisible by 50 against all: shared seeds are joined,
a pair's ordered matches are chained with gap costs through a Fenwick tree of maxima, and the chains
are aligned between their matches.

Defined results: letters are upper case without '-' and white space; null, empty and shorter texts
have no window and no row; a window repeated within one record only isn't shared; equal texts under
two ids are shared whole; a null id is left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.letters import LETTER, first_least, joined, mixed, windows

K = 16
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i
_BACK = np.frombuffer(b"ACGT", np.uint8)
HOT, SAMPLE, MOST_HOT = 2_000, 0.01, 1_000_000


def units(codes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, seed, start in codes, windows, offset of the record) of each unit."""
    none = np.zeros(0, np.int64)
    if len(codes) < least:
        return none, none.astype(np.uint64), none, none, none
    h = mixed(windows(LETTER[codes], K))
    at = first_least(h, least - K + 1)
    lengths = np.diff(offsets)
    record = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.arange(len(at))
    ok = starts + least <= offsets[record[: len(at)] + 1]
    starts, at, record = starts[ok], at[ok], record[: len(ok)][ok]
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (record[1:] != record[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(starts)])))
    return record[first], h[at[first]], starts[first], count, offsets[record[first]]


def packed_letters(codes: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> pa.Array:
    """Each unit's letters: 2 bits a letter if all are A, C, G or T (an odd last byte marks it), else bytes."""
    most += -most % 4
    grid = start[:, None] + np.arange(most)
    inside = np.arange(most) < size[:, None]
    letters = codes[np.minimum(grid, len(codes) - 1)]
    two = _CODE[letters]
    plain = (two < 4) | ~inside
    short = plain.all(axis=1)
    four = np.where(inside, two & 3, 0).reshape(len(start), most // 4, 4)
    packed = (four[..., 0] << 6) | (four[..., 1] << 4) | (four[..., 2] << 2) | four[..., 3]
    n = np.where(short, (size + 3) // 4, size)
    both = np.zeros((len(start), most), np.uint8)
    both[short, : most // 4] = packed[short]
    both[~short] = letters[~short]
    flat = both[np.arange(most) < n[:, None]]
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def letter_grid(blobs: pa.Array, size: np.ndarray, most: int) -> np.ndarray:
    """The letters of units as rows, filled with 0 after their end."""
    most += -most % 4
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    raw = np.frombuffer(blobs.buffers()[2], np.uint8)
    n = np.diff(offsets)
    grid = raw[np.minimum(offsets[:-1, None] + np.arange(most), len(raw) - 1)]
    short = n < size  # packed
    quarter = grid[:, : most // 4]
    four = np.stack([(quarter >> s) & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(grid), most)
    grid = np.where(short[:, None], _BACK[four], grid)
    grid[np.arange(most) >= size[:, None]] = 0
    return grid


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of each run of True along rows."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def shared_intervals(rowid: np.ndarray, start: np.ndarray, count: np.ndarray, blobs: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rowid, from, to) of the letters in windows that several records of these units hold."""
    most = 2 * least - K
    grid = LETTER[letter_grid(blobs, count + least - 1, most)]
    hashes = windows(grid, least)[:, : most - least + 1]
    valid = np.arange(hashes.shape[1]) < count[:, None]
    keys = hashes[valid]
    owner = np.repeat(rowid, count)
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    many = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
    flat = np.empty(len(keys), bool)
    flat[order] = np.repeat(many, np.diff(np.concatenate((first, [len(k)]))))
    flags = np.zeros(valid.shape, bool)
    flags[valid] = flat
    row, a, b = runs(flags)
    return rowid[row], start[row] + a, start[row] + b + least - 1


def seeds(records: DataFrame, least: int, with_letters: bool = True, hot=None, wanted: bool = False) -> DataFrame:
    """(seed, rowid, start, windows, letters) of every unit of records (rowid, seq), or with hot (a broadcast of seeds in
    order) of those whose seed is one of them, or isn't, as wanted."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                some = part.slice(at, 2000)
                ids = some.column(0).to_numpy(zero_copy_only=False)
                codes, offsets = joined(some.column(1))
                record, seed, start, count, base = units(codes, offsets, least)
                if hot is not None and len(hot.value):
                    is_hot = hot.value[np.minimum(np.searchsorted(hot.value, seed), len(hot.value) - 1)] == seed
                    record, seed, start, count, base = (x[is_hot == wanted] for x in (record, seed, start, count, base))
                if not len(seed):
                    continue
                columns = [pa.array(seed.view(np.int64)), pa.array(ids[record].astype(np.int64))]
                if with_letters:
                    columns += [pa.array((start - base).astype(np.int32)), pa.array(count.astype(np.int32)), packed_letters(codes, start, count + least - 1, 2 * least - K)]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "rowid", "start", "windows", "letters"][: len(columns)])

    schema = "seed bigint, rowid bigint" + ", start int, windows int, letters binary" * with_letters
    return records.where("rowid is not null and seq is not null").select("rowid", "seq").mapInArrow(make, schema)


def hot_seeds(records: DataFrame, least: int) -> np.ndarray:
    """Seeds that about HOT records or more hold, told from a sample, in order."""
    some = records.sample(fraction=SAMPLE, seed=11)
    counts = seeds(some, least, with_letters=False).distinct().groupBy("seed").count()
    top = counts.where(F.col("count") >= HOT * SAMPLE).orderBy(F.desc("count"), "seed").limit(MOST_HOT).toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def by_seed(found: DataFrame, least: int, parts: int, rows_at_once: int = 30_000) -> DataFrame:
    """(rowid, from, to) of shared windows, compared seed by seed."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            seed, rowid = t.column("seed").to_numpy(), t.column("rowid").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
            many = np.minimum.reduceat(rowid, first) != np.maximum.reduceat(rowid, first)
            keep = np.repeat(many, np.diff(np.concatenate((first, [len(seed)]))))
            if not keep.any():
                return
            t = t.filter(pa.array(keep))
            a, b, c = shared_intervals(t.column("rowid").to_numpy(), t.column("start").to_numpy().astype(np.int64), t.column("windows").to_numpy().astype(np.int64), t.column("letters").combine_chunks(), least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32))], ["rowid", "from", "to"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows_at_once:
                t = pa.Table.from_batches(held)
                seed = t.column("seed").to_numpy()
                at = int(np.searchsorted(seed, seed[-1], side="left"))  # the last seed may go on
                if at:
                    yield from solve(t.slice(0, at))
                    held, n = t.slice(at).combine_chunks().to_batches(), t.num_rows - at
        if n:
            yield from solve(pa.Table.from_batches(held))

    return found.repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(compare, "rowid bigint, from int, to int")


def by_window(found: DataFrame, least: int, salts: int = 32) -> DataFrame:
    """(rowid, from, to) of shared windows of hot seeds, by their hashes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                some = batch.slice(at, 5000)
                rowid, start, count = (some.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
                grid = LETTER[letter_grid(some.column(4), count + least - 1, 2 * least - K)]
                hashes = windows(grid, least)[:, : least - K + 1]
                valid = np.arange(hashes.shape[1]) < count[:, None]
                row, j = np.nonzero(valid)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[valid].view(np.int64)), pa.array(rowid[row]), pa.array((start[row] + j).astype(np.int32))], ["window", "rowid", "at"])

    every = found.mapInArrow(explode, "window bigint, rowid bigint, at int")
    shared = every.groupBy("window").agg(F.min("rowid").alias("a"), F.max("rowid").alias("b")).where("a <> b").select("window", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = every.withColumn("salt", F.pmod(F.xxhash64("rowid", "at"), F.lit(salts)).cast("int"))
    return salted.join(shared, ["window", "salt"]).select("rowid", F.col("at").alias("from"), (F.col("at") + least).alias("to"))


def united(intervals: DataFrame) -> DataFrame:
    """(rowid, shared_letters): the number of letters that a record's intervals cover."""
    whole = intervals.groupBy("rowid").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("all"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("upto"))

    def add(acc, x):
        return F.struct((acc["sum"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], acc["upto"]))).alias("sum"), F.greatest(acc["upto"], x["to"]).alias("upto"))

    return whole.select("rowid", F.aggregate("all", start, add, lambda acc: acc["sum"]).alias("shared_letters"))


def shared_spans(records: DataFrame, least: int = 64, rows_per_task: int = 250_000) -> DataFrame:
    """(rowid, shared_letters) of each record (rowid, seq) that shares a stretch of at least so many letters with another."""
    size = records.agg(F.sum(F.length("seq"))).first()[0] or 0
    parts = max(8, int(size * 2 / (least - K + 2) / rows_per_task) + 1)
    hot = hot_seeds(records, least)
    if not len(hot):
        return united(by_seed(seeds(records, least), least, parts))
    sent = records.sparkSession.sparkContext.broadcast(hot)
    return united(by_seed(seeds(records, least, hot=sent), least, parts).unionByName(by_window(seeds(records, least, hot=sent, wanted=True), least)))
