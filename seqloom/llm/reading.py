"""Reading level of documents by surprisal under interpolated n-gram models.

Each document is cut to its author's own words (texts.own_text). Two letter n-gram models of order 4,
interpolated by Witten and Bell's rule, are trained on labelled documents: one on easy ones (mean
label up to `hard_from`), one on hard ones. Every document is read whole under both: its surprisal
distribution under the easy model is reported, and the difference of its mean surprisals, shrunk to 0
for short texts, is mapped to the label scale by isotonic regression. The regression is fitted on
scores under models trained on the other half of the labelled documents.

The n-grams are counted on executors; only counts (at most 4 x 40**4 numbers) and one score for each
of at most max_labelled labelled documents come to the driver; the models sent along have 2 x 40**4
numbers, whatever the data's size. Documents are not shuffled.

Defined results: null labels are left out, several labels of a document are averaged; documents
without own words (null, empty, deleted, quotes only) have surprisals null and the level of score 0;
without labels of both kinds every level is null; texts of any length are read whole; repeated rows
are scored alike; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.texts import own_text
from seqloom.runtime import small_or_plain, written

#: Letters above ASCII have the symbols from ASCII_SYMBOLS on.
ORDER, ASCII_SYMBOLS, SYMBOLS = 4, 32, 40
#: A fit takes at most so many labelled documents, those with the least hash of their id.
MAX_LABELLED = 200_000
#: Letters of no evidence that every document's score is averaged with.
SHRINK = 30


def symbol_table() -> np.ndarray:
    """A symbol below 32 for each ASCII character: letters 1-26, white space 27, digits 28, ends of sentences 29, commas and the like 30, the rest 31."""
    t = np.full(128, 31, np.int64)
    for k in range(26):
        t[ord("a") + k] = t[ord("A") + k] = k + 1
    for chars, k in ((" \t\n\r\x0b\x0c", 27), ("0123456789", 28), (".!?", 29), (",;:()", 30)):
        for c in chars:
            t[ord(c)] = k
    return t


_TABLE = symbol_table()


@functools.cache
def symbol_above(code: int) -> int:
    """The symbol of a code point above ASCII: of a letter in either case by a hash, of signs and spaces as of those of ASCII."""
    c = chr(code)
    if c.isalpha():
        return ASCII_SYMBOLS + (ord(c.lower()[0]) * 0x9E3779B1 >> 16) % (SYMBOLS - ASCII_SYMBOLS)
    for chars, k in (("。！？…｡", 29), ("、，；：（）､", 30)):
        if c in chars:
            return k
    return 27 if c.isspace() else 28 if c.isdecimal() else 31


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = _TABLE[np.minimum(codes, 127)]
    above = codes > 127
    if above.any():
        kinds, which = np.unique(codes[above], return_inverse=True)
        s[above] = np.array([symbol_above(c) for c in kinds.tolist()], np.int64)[which]
    return s


def grams(text: str) -> np.ndarray:
    """The index of the n-gram that ends at each letter; symbol 0 stands before the text, runs of equal white space or other signs count once."""
    s = symbols(text)
    s = s[np.concatenate(([True], (s[1:] != s[:-1]) | (s[1:] < 27) | (s[1:] >= ASCII_SYMBOLS)))] if len(s) else s
    padded = np.concatenate((np.zeros(ORDER - 1, np.int64), s))
    g = np.zeros(len(s), np.int64)
    for k in range(ORDER):
        g = g * SYMBOLS + padded[k : k + len(s)]
    return g


def interpolated(counts: np.ndarray) -> np.ndarray:
    """Surprisal in bits of each n-gram's last symbol after the others, from the counts of n-grams."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in range(1, ORDER + 1):
        c = counts.reshape(-1, SYMBOLS ** n).sum(axis=0).reshape(-1, SYMBOLS).astype(np.float64)
        kinds = (c > 0).sum(axis=1, keepdims=True)
        total = c.sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if n > 1 else 1, 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return -np.log2(p).astype(np.float32).ravel()


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the best non-decreasing fit."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum of y, number, least x, greatest x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], top]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    return knots, np.repeat([b[0] / b[1] for b in blocks], 2)


def quantiles(values: np.ndarray, wanted: tuple[float, ...]) -> list[float]:
    """As np.quantile(), which takes far longer for short arrays."""
    v = np.sort(values)
    at = [q * (len(v) - 1) for q in wanted]
    return [float(v[int(x)] + (x - int(x)) * (v[min(int(x) + 1, len(v) - 1)] - v[int(x)])) for x in at]


def score(g: np.ndarray, easy: np.ndarray, hard: np.ndarray) -> float:
    return float((easy[g] - hard[g]).sum() / (len(g) + SHRINK)) if len(g) else 0.0


def labelled_texts(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, level: str, most: int) -> DataFrame:
    """(doc_id, level, half, own) of at most so many labelled documents."""
    mean = labels.where(F.col(level).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.avg(level).alias("level"))
    mean = mean.withColumn("h", F.xxhash64(F.lit(7), doc_id)).orderBy("h", doc_id).limit(most)
    own = F.pandas_udf(lambda t: t.map(own_text), "string")
    joined = documents.select(doc_id, text).join(small_or_plain(mean), doc_id)
    return joined.select(doc_id, "level", F.pmod("h", F.lit(2)).cast("int").alias("half"), own(F.col(text)).alias("own"))


def counted(texts: DataFrame, hard_from: float) -> np.ndarray:
    """Counts of n-grams by half and kind (easy, hard)."""
    size = SYMBOLS ** ORDER

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for level, half, own in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                g = grams(own or "")
                model = half * 2 + int(level > hard_from)
                if len(g):
                    u, n = np.unique(g, return_counts=True)
                    sums.setdefault(model, np.zeros(size, np.int64))[u] += n
        for model, c in sums.items():
            at = np.flatnonzero(c)
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some + model * size), pa.array(c[some])], ["gram", "n"])

    rows = texts.select("level", "half", "own").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    out = np.zeros(4 * size, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(2, 2, size)


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", level: str = "reading_level", hard_from: float = 3.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, letters, mean, sd, p50, p90, score, level): surprisals in bits a letter under the easy model."""
    spark = documents.sparkSession
    texts = written(labelled_texts(documents, labels, doc_id, text, level, max_labelled), "labelled")
    halves = counted(texts, hard_from)
    kinds = halves.sum(axis=(0, 2)).tolist()
    size = SYMBOLS ** ORDER
    if min(kinds) == 0:
        easy = hard = np.full(size, np.log2(SYMBOLS), np.float32)
        knots, values = np.array([0.0]), np.array([np.nan])
    else:
        easy, hard = (interpolated(halves[:, k].sum(axis=0)) for k in (0, 1))
        crossed = spark.sparkContext.broadcast([[interpolated(halves[1 - h, k]) for k in (0, 1)] for h in (0, 1)])

        def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                half, own = part.column(0).to_pylist(), part.column(1).to_pylist()
                x = [score(grams(t or ""), *crossed.value[h]) for h, t in zip(half, own, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), part.column(2)], ["x", "y"])

        pairs = texts.select("half", "own", "level").mapInArrow(scored, "x double, y double").toArrow()
        knots, values = isotonic(pairs.column("x").to_numpy(), pairs.column("y").to_numpy())
    sent = spark.sparkContext.broadcast((easy, hard, knots, values))
    names = ["letters", "mean", "sd", "p50", "p90", "score", "level"]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        easy, hard, knots, values = sent.value
        for part in parts:
            rows = []
            for t in part.column(1).to_pylist():
                g = grams(own_text(t))
                bits = easy[g]
                x = score(g, easy, hard)
                shape = (float(bits.mean()), float(bits.std()), *quantiles(bits, (0.5, 0.9))) if len(g) else (None,) * 4
                estimate = float(np.interp(x, knots, values))
                rows.append((len(g), *shape, x, None if np.isnan(estimate) else estimate))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]], [doc_id, *names])

    return documents.select(doc_id, text).mapInArrow(read, f"`{doc_id}` bigint, letters bigint, mean double, sd double, p50 double, p90 double, score double, level double")
