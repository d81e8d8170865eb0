"""Chained fuzzy passages between query records and all records.

Seeds (minimizers of short windows) of the queries are joined with those of all records. A pair's
matches, ordered on the query, are chained: a match may follow another if it lies after it on both
records; the gain is its new letters, the cost grows with the gap's size and its shift of diagonal.
The best predecessor up to a target position is kept in a Fenwick tree of maxima, so n matches take
n log n steps. Every match goes to one chain. Chains are then aligned: they are extended outwards
while letters are equal, and gaps between their matches are compared letter by letter, which gives
each passage's identity.

The queries are a stated set (ids divisible by 50), in blocks of pairs sorted by partition; a hot seed
only repeats for the queries that hold it. Defined results: as for spans.shared_spans(); a record
isn't compared with itself; each of a pair's extended chains that reaches `least` letters of the query
is reported, unless it lies in a better one and all its runs of equal letters are runs of that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.letters import LETTER, first_least, joined, mixed, windows

K, WINDOW = 20, 12


class Maxima:
    """Fenwick tree of the largest (value, index) up to a position."""

    def __init__(self, n: int):
        self.tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.tree):
            if value > self.tree[at]:
                self.tree[at] = value
            at += at & -at

    def best(self, upto: int) -> tuple[float, int]:
        out, at = (float("-inf"), -1), upto
        while at > 0:
            if self.tree[at] > out:
                out = self.tree[at]
            at -= at & -at
        return out


def chained(q: list[int], t: list[int], size: int = K, gap: float = 0.1) -> tuple[float, list[int]]:
    """(score, matches) of the best chain of matches (q[i], t[i]) of equal size.

    The cost of a gap is `gap` a letter on both records, which splits into a part of each match, so
    that the best predecessor is a maximum over all that lie before; overlapping matches of one
    diagonal extend each other by their new letters.
    """
    order, score, before = linked(q, t, size, gap)
    top = max(order, key=lambda i: score[i])
    return score[top], traced(top, before)


def traced(top: int, before: list[int]) -> list[int]:
    path = [top]
    while before[path[-1]] >= 0:
        path.append(before[path[-1]])
    return path[::-1]


def all_chained(q: list[int], t: list[int], size: int = K, gap: float = 0.1) -> list[tuple[float, list[int]]]:
    """(score, matches) of chains that hold each match once.

    A round takes the chains that share no match with a better one; the matches of the others are
    chained again, until none is left.
    """
    out, rest = [], list(range(len(q)))
    while rest:
        order, score, before = linked([q[i] for i in rest], [t[i] for i in rest], size, gap)
        used, seen = [False] * len(rest), [False] * len(rest)
        for top in sorted(order, key=lambda i: -score[i]):
            if seen[top]:
                continue
            path, at = [], top
            while at >= 0 and not seen[at]:
                path.append(at)
                seen[at] = True
                at = before[at]
            if at < 0:
                for i in path:
                    used[i] = True
                out.append((score[top], [rest[i] for i in path[::-1]]))
        rest = [x for i, x in enumerate(rest) if not used[i]]
    return out


def linked(q: list[int], t: list[int], size: int, gap: float) -> tuple[list[int], list[float], list[int]]:
    """(matches in order, score of the best chain that ends at each match, the match before it there or -1)."""
    order = sorted(range(len(q)), key=lambda i: (q[i], t[i]))
    ends = sorted({t[i] + size for i in order})
    rank = {e: k for k, e in enumerate(ends)}
    import bisect

    tree, score, before = Maxima(len(ends)), [0.0] * len(q), [-1] * len(q)
    waiting: list[tuple[int, int]] = []  # (end on the query, match), in order of their starts
    last_on: dict[int, int] = {}
    done = 0
    for i in order:
        while done < len(waiting) and waiting[done][0] <= q[i]:
            j = waiting[done][1]
            tree.put(rank[t[j] + size], (score[j] + gap * (q[j] + t[j] + 2 * size), j))
            done += 1
        score[i] = float(size)
        value, j = tree.best(bisect.bisect_right(ends, t[i]))
        if j >= 0 and value - gap * (q[i] + t[i]) + size > score[i]:
            score[i], before[i] = value - gap * (q[i] + t[i]) + size, j
        j = last_on.get(t[i] - q[i], -1)
        if j >= 0 and q[i] - q[j] < size and score[j] + q[i] - q[j] > score[i]:
            score[i], before[i] = score[j] + q[i] - q[j], j
        last_on[t[i] - q[i]] = i
        waiting.append((q[i] + size, i))
    return order, score, before


def minimizers(records: DataFrame) -> DataFrame:
    """(seed, rowid, at) of the minimizers of records (rowid, seq)."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, 2000):
                some = part.slice(begin, 2000)
                codes, offsets = joined(some.column(1))
                if len(codes) < K + WINDOW - 1:
                    continue
                h = mixed(windows(LETTER[codes], K))
                at = first_least(h, WINDOW)
                record = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
                at = np.unique(at[np.arange(len(at)) + K + WINDOW - 1 <= offsets[record + 1]])
                record = np.searchsorted(offsets, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), some.column(0).take(pa.array(record)), pa.array((at - offsets[record]).astype(np.int32))], ["seed", "rowid", "at"])

    return records.where("rowid is not null and seq is not null").select("rowid", "seq").mapInArrow(make, "seed bigint, rowid bigint, at int")


def passages(records: DataFrame, least: int = 64, every: int = 50) -> DataFrame:
    """(query_id, target_id, query_start, query_end, target_start, target_end, matches, score, identity) of the chains of each pair."""
    seeds = minimizers(records)
    queries = seeds.where(F.col("rowid") % every == 0).select("seed", F.col("rowid").alias("query_id"), F.col("at").alias("q"))
    hits = seeds.join(queries, "seed").where("rowid <> query_id").select("query_id", F.col("rowid").alias("target_id"), "q", F.col("at").alias("t"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: tuple[int, int], q: list[int], t: list[int]) -> list:
            # of 12 k-mers in a row that equal the other record's one is a match, so equal letters go on for at most 11 k-mers beyond a diagonal's last match
            beyond = WINDOW - 1
            if len(q) == 1 and K + 2 * beyond < least:
                return []
            low: dict[int, int] = {}
            high: dict[int, int] = {}
            for x, y in zip(q, t, strict=True):
                low[y - x], high[y - x] = min(x, low.get(y - x, x)), max(x, high.get(y - x, x))
            found = [(value, p) for value, p in all_chained(q, t) if high[t[p[-1]] - q[p[-1]]] + K - low[t[p[0]] - q[p[0]]] + 2 * beyond >= least]
            if not found:
                return []
            return [(*key, [value for value, _ in found], [[[q[i], t[i]] for i in path] for _, path in found])]

        key, q, t, out = None, [], [], []
        for b in batches:
            for a, c, x, y in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if (a, c) != key:
                    if q:
                        out += solve(key, q, t)
                    key, q, t = (a, c), [], []
                q.append(x)
                t.append(y)
            if len(out) > 5000:
                yield batch(out)
                out = []
        if q:
            out += solve(key, q, t)
        if out:
            yield batch(out)

    def batch(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["query_id", "target_id", "scores", "chains"])

    schema = "query_id bigint, target_id bigint, scores array<double>, chains array<array<array<int>>>"
    chains = hits.repartition("query_id", "target_id").sortWithinPartitions("query_id", "target_id").mapInArrow(chain, schema)
    return aligned(chains, records, least)


def equal(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal letters at the start."""
    n = min(len(a), len(b))
    return int(np.argmin(np.append(a[:n] == b[:n], False)))


def runs_of_equal(x: np.ndarray, y: np.ndarray, anchors: list[list[int]], known: dict[int, np.ndarray]) -> set[tuple[int, int]]:
    """(diagonal, number of the run of equal letters on it) of the anchors' runs; known holds where letters of a diagonal differ."""
    out = set()
    for p, r in anchors:
        d = r - p
        if d not in known:
            first = max(0, -d)
            n = min(len(x) - first, len(y) - first - d)
            known[d] = first + np.flatnonzero(x[first : first + n] != y[first + d : first + d + n])
        out.add((d, int(np.searchsorted(known[d], p))))
    return out


def aligned(chains: DataFrame, records: DataFrame, least: int) -> DataFrame:
    """Chains, extended outwards by equal letters, that reach `least` letters, with the identity of their passages: exact letters at matches, letter by letter between them."""
    names = ["query_id", "target_id", "query_start", "query_end", "target_start", "target_end", "matches", "score", "identity"]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64(), pa.float64()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            q_codes, q_off = joined(b.column(4))
            t_codes, t_off = joined(b.column(5))
            for k, (query, target, scores, found) in enumerate(zip(*[b.column(c).to_pylist() for c in range(4)], strict=True)):
                x, y = q_codes[q_off[k] : q_off[k + 1]], t_codes[t_off[k] : t_off[k + 1]]
                told: list[tuple[tuple[int, int, int, int], set[tuple[int, int]]]] = []
                known: dict[int, np.ndarray] = {}
                for score, anchors in zip(scores, found, strict=True):
                    (p, r), (p2, r2) = anchors[0], anchors[-1]
                    left, right = equal(x[:p][::-1], y[:r][::-1]), equal(x[p2 + K :], y[r2 + K :])
                    ends = (p - left, p2 + K + right, r - left, r2 + K + right)
                    if ends[1] - ends[0] < least:
                        continue
                    runs = runs_of_equal(x, y, anchors, known)
                    if any(e[0] <= ends[0] and ends[1] <= e[1] and e[2] <= ends[2] and ends[3] <= e[3] and runs <= own for e, own in told):
                        continue
                    told.append((ends, runs))
                    same = total = K + left + right
                    for (p, r), (p2, r2) in zip(anchors, anchors[1:], strict=False):
                        a, c = x[p + K : p2 + K], y[r + K : r2 + K]  # an anchor's end to the next one's end
                        head = equal(a, c)
                        rest = min(len(a), len(c)) - head
                        tail = equal(a[::-1][:rest], c[::-1][:rest])
                        same, total = same + head + tail, total + max(len(a), len(c))
                    rows.append((query, target, *ends, len(anchors), score, same / total))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    text = records.select("rowid", "seq")
    both = chains.join(text.withColumnsRenamed({"rowid": "query_id", "seq": "query_seq"}), "query_id").join(text.withColumnsRenamed({"rowid": "target_id", "seq": "target_seq"}), "target_id")
    return both.select("query_id", "target_id", "scores", "chains", "query_seq", "target_seq").mapInArrow(align, "query_id bigint, target_id bigint, query_start int, query_end int, target_start int, target_end int, matches int, score double, identity double")
