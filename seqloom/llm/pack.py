"""Filling containers of fixed capacity with documents, measured in tokens.

Vector bin packing: an item has a number of tokens, of segments (1) and of loss-bearing tokens (those
that hold letters of its author's own words). A container has a limit for each. One container at a time is open; of
the items that still fit on all counts the one with the largest dot product of its demand with
the room left, both as fractions of the limits, is placed next. All three are counted for every item, also
where the loss limit is the capacity. Of items that are alike but for their tokens the largest that fits has the largest
product; largest_first() finds it by a search in the sorted sizes.

Items are packed in chunks of at most `chunk` items, in the partitions in which they are read, without
a shuffle. Containers of a chunk that stay below `refill` of their tokens are opened again and their
items, a few for each chunk, are spread evenly and packed once more across chunks. So no task holds
more than one chunk, whatever the data's size or skew. Which documents meet in a chunk depends on how the
table is read; the limits hold for any reading.

A document larger than the capacity is cut into pieces of exactly the capacity and a rest; only such
documents are cut. Each text is tokenized once; loss-bearing tokens are counted for each piece.

Defined results: a document without tokens (null or empty text) is placed like any other and takes
one segment; a piece that exceeds the loss limit by itself has a container of its own and over = true; a
spec whose capacity is null or below 1 has no containers; repeated rows are separate
items; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.texts import TOKENIZERS, batches, loaded, own_letters, sent_along
from seqloom.runtime import small_or_plain, written

#: Specs are a driver-side list and may be at most so many.
MOST_SPECS = 1000


def placed(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each item. demand: items x dimensions, each row within limits."""
    n = len(demand)
    bins = np.full(n, -1, np.int64)
    scaled = (demand / limits).astype(np.float32)
    order = np.lexsort((np.arange(n), -scaled[:, 0]))
    left, share = np.ascontiguousarray(demand[order].T), np.ascontiguousarray(scaled[order].T)
    ids, gone, current, alive = order.copy(), np.zeros(n, np.float32), 0, n
    while alive:
        room, steps, most = limits.astype(np.int64).copy(), -left[0], left.max(axis=1)
        while True:
            fits = int(np.searchsorted(steps, -room[0]))  # from here on, as items are in the order of their first demand
            gain = gone[fits:].copy()
            for own, free in zip(share, (room / limits).astype(np.float32), strict=True):
                gain += own[fits:] * free
            for own, free, top in zip(left[1:], room[1:], most[1:], strict=True):
                if top > free:
                    np.putmask(gain, own[fits:] > free, -1)
            k = int(gain.argmax()) if len(gain) else -1
            if k < 0 or gain[k] < 0:
                break
            k += fits
            gone[k] = -np.inf
            bins[ids[k]] = current
            room -= left[:, k]
            alive -= 1
        current += 1
        if alive < len(ids) // 2:
            keep = gone == 0
            left, share, ids, gone = left[:, keep], share[:, keep], ids[keep], gone[keep]
    return bins


def largest_first(sizes: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """The container of each item if sizes and numbers of items are limited: always the largest item that fits."""
    order = np.argsort(-sizes, kind="stable")
    left = sizes[order].tolist()
    keys = [-x for x in left]
    following = list(range(len(left) + 1))  # the next item that isn't placed, from each position

    def free(k: int) -> int:
        top = k
        while following[top] != top:
            top = following[top]
        while following[k] != top:
            following[k], k = top, following[k]
        return top

    bins, current = np.empty(len(left), np.int64), -1
    while (k := free(0)) < len(left):
        room, items, current = capacity, 0, current + 1
        while k < len(left) and items < most:
            bins[order[k]] = current
            following[k] = k + 1
            room, items = room - left[k], items + 1
            k = free(bisect.bisect_left(keys, -room))
    return bins


def token_counts(df: DataFrame, doc_id: str, text: str, name: str, folder: str) -> DataFrame:
    """(doc_id, tokens, own) of each document; own are the starts and ends, in turn, of the runs of loss-bearing tokens."""
    vocabulary = sent_along(df.sparkSession, name, folder)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(vocabulary.value)
        for part in parts:
            texts = [x or "" for x in part.column(1).to_pylist()]
            total, own = [], []
            for some in batches(texts):
                found = tokenizer.encode_batch(some, add_special_tokens=False)
                own += [own_runs(t, e.offsets) for t, e in zip(some, found, strict=True)]
                total += [len(e) for e in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(own, pa.list_(pa.int64()))], [doc_id, "tokens", "own"])

    return df.select(doc_id, text).mapInArrow(count, f"`{doc_id}` bigint, tokens bigint, own array<bigint>")


def own_runs(text: str, offsets: list[tuple[int, int]]) -> list[int]:
    if not offsets:
        return []
    upto = np.concatenate(([0], np.cumsum(own_letters(text))))
    at = np.array(offsets, np.int64)
    flags = np.concatenate(([0], (upto[at[:, 1]] > upto[at[:, 0]]).astype(np.int8), [0]))
    return np.flatnonzero(np.diff(flags)).tolist()


def limits_of(capacity: int, segments: int | None, loss_share: float) -> np.ndarray:
    return np.array([capacity, segments or max(16, capacity // 16), max(1, int(capacity * loss_share))], np.int64)


def pieces_of(tokens: int, own: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(start, tokens, loss-bearing tokens) of the pieces of a document; more than one only if it exceeds the capacity."""
    if tokens <= capacity:
        return [(0, tokens, sum(own[1::2]) - sum(own[::2]))]
    runs = np.array(own, np.int64).reshape(-1, 2)
    starts = range(0, tokens, capacity)
    return [(a, min(capacity, tokens - a), int(np.maximum(0, np.minimum(runs[:, 1], a + capacity) - np.maximum(runs[:, 0], a)).sum())) for a in starts]


_OUT = ["piece", "token_start", "tokens", "loss", "over", "fill", "container"]


def packed(df: DataFrame, specs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, segments: int | None = None, loss_share: float = 1.0, chunk: int = 4_096, refill: float = 0.98) -> DataFrame:
    """(spec_id, container, doc_id, piece, token_start, tokens, loss, over) of every document for every spec.

    segments: most items of a container, by default one for each 16 tokens, 16 at least.
    loss_share: a container's limit of loss-bearing tokens as a share of its capacity.
    chunk: so many items are packed at once; the work on a chunk grows with its square.
    """
    wanted = [(r["spec_id"], r["capacity_tokens"]) for r in specs.where("capacity_tokens >= 1").select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()]
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    limits = {k: limits_of(c, segments, loss_share) for k, c in wanted}
    schema = f"spec_id bigint, `{doc_id}` bigint, piece int, token_start bigint, tokens bigint, loss bigint, over boolean, fill double, container bigint"

    def filled(spec: int, ids: pa.Array, rows: np.ndarray, base: int) -> pa.RecordBatch:
        """Items (piece, start, tokens, loss) of one spec in containers."""
        most = limits[spec]
        over = rows[:, 3] > most[2]
        bins = np.arange(len(rows))
        bins[~over] = placed(np.column_stack((rows[~over, 2], np.ones((~over).sum(), np.int64), rows[~over, 3])), most) + len(rows)
        _, bins = np.unique(bins, return_inverse=True)
        fill = np.where(over, 1.0, np.bincount(bins, weights=rows[:, 2])[bins] / most[0]) if len(rows) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array([spec] * len(rows), pa.int64()), ids, pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(over), pa.array(fill), pa.array(base + bins)], ["spec_id", doc_id, *_OUT])

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for part in parts:
            at = 0
            while at < part.num_rows:
                some = part.slice(at, chunk - n)
                held.append(some)
                n, at = n + some.num_rows, at + some.num_rows
                if n == chunk:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def base_of(number: int) -> int:
        from pyspark import TaskContext

        return (TaskContext.get().partitionId() << 40) + (number << 20)

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for t in chunks(parts):
            ids, tokens, own = (t.column(k).to_pylist() for k in range(3))
            for spec, most in limits.items():
                rows, owners = [], []
                for i, n, runs in zip(ids, tokens, own, strict=True):
                    for k, p in enumerate(pieces_of(n, runs, int(most[0]))):
                        rows.append((k, *p))
                        owners.append(i)
                for at in range(0, len(rows), chunk):
                    yield filled(spec, pa.array(owners[at : at + chunk], pa.int64()), np.array(rows[at : at + chunk], np.int64), base_of(number))
                    number += 1

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for t in chunks(parts):
            spec_of = t.column("spec_id").to_numpy()
            for spec in np.unique(spec_of):
                own = t.filter(pa.array(spec_of == spec))
                rows = np.column_stack([own.column(c).to_numpy() for c in _OUT[:4]]).astype(np.int64)
                yield filled(int(spec), own.column(doc_id).combine_chunks(), rows, (1 << 62) + base_of(number))
                number += 1

    once = written(token_counts(df, doc_id, text, name, folder).mapInArrow(first, schema), "packed")
    rest = once.where(F.col("fill") < refill)
    share = max(1, rest.count() // chunk)
    more = rest.repartition(share).mapInArrow(again, schema)
    return once.where(F.col("fill") >= refill).unionByName(more).select("spec_id", "container", doc_id, "piece", "token_start", "tokens", "loss", "over")


def containers(assigned: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, items, tokens, unused, lower) for each spec: unused is the share of capacity left empty, lower the least number of containers for so many tokens."""
    each = assigned.groupBy("spec_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    sums = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    with_capacity = sums.join(small_or_plain(specs.select("spec_id", "capacity_tokens")), "spec_id")
    return with_capacity.select("spec_id", "containers", "items", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("lower"))


def broken(assigned: DataFrame, specs: DataFrame, segments: int | None = None, loss_share: float = 1.0) -> DataFrame:
    """(spec_id, container) of containers that break a limit without being flagged: none."""
    capacity = F.col("capacity_tokens")
    each = assigned.groupBy("spec_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.max("over").alias("over"))
    most = F.lit(segments) if segments else F.greatest(F.lit(16), F.floor(capacity / 16))
    wrong = (F.col("tokens") > capacity) | (F.col("items") > most) | (~F.col("over") & (F.col("loss") > F.greatest(F.lit(1), F.floor(capacity * loss_share)))) | (F.col("over") & (F.col("items") > 1))
    return each.join(small_or_plain(specs.select("spec_id", "capacity_tokens")), "spec_id").where(wrong).select("spec_id", "container")
