"""Column expressions over sequences (strings of letters) and qualities (arrays of int).

All are built-in functions inside code generation or higher-order functions; none is a Python UDF.
Null in gives null out; an empty sequence gives an empty or zero result unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in T, C, A, G order.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
#: IUPAC degenerate bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = ("ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd")


def cleaned(seq: Column) -> Column:
    """Upper case without gaps and white space."""
    return F.upper(F.regexp_replace(seq, r"[-\s]", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def count_of(seq: Column, letters: str) -> Column:
    """How many letters of seq are among letters, in any case."""
    both = letters.upper() + letters.lower()
    return F.length(seq) - F.length(F.translate(seq, both, ""))


def gc_fraction(seq: Column) -> Column:
    """G and C among the A, C, G, T and N; null if there are none of these."""
    total = count_of(seq, "ACGTN")
    return F.when(total > 0, count_of(seq, "GC") / total)


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k letters in order; an empty array for shorter sequences.

    One pass of a look-ahead, as a substring at position i costs i steps.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def letters(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.split(seq, "")).when(seq.isNotNull(), F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two sequences of equal length; null if the lengths differ."""
    return F.when(F.length(a) == F.length(b), F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x))


def translated(seq: Column, frame: int = 0) -> Column:
    """Amino acids of the whole codons from frame on; a codon with other letters than A, C, G, T is X."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    count = F.floor((F.length(seq) - frame) / 3).cast("int")
    acids = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(seq, i * 3 + 1 + frame, F.lit(3))), F.lit("X")))
    return F.when(count > 0, F.array_join(acids, "")).when(seq.isNotNull(), F.lit(""))


def homopolymers(seq: Column) -> Column:
    """The runs of one letter, in order."""
    return F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), 1)


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def window_means(values: Column, size: int, step: int, last: bool = True) -> Column:
    """array<struct<pos, mean>> over windows of size values; last: whether the window that ends with the array counts."""
    upto = F.size(values) - size - (0 if last else 1)
    starts = F.when(upto >= 0, F.sequence(F.lit(0), upto, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), (F.aggregate(F.slice(values, i + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x) / size).alias("mean")))


def entropy_of(counts: list[Column], base: float = 2.0) -> Column:
    """Shannon entropy of a list of counts; 0 if they are all 0."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.log(F.lit(base), c / total)).otherwise(F.lit(0.0)) for c in counts]
    return sum(terms[1:], terms[0])


def degenerate_pattern(motif: str) -> str:
    """A regular expression for a motif of IUPAC letters."""
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}{c}]" for c in motif.upper())


def degenerate_forms(motif: str) -> list[str]:
    """Every sequence that a motif of IUPAC letters stands for."""
    forms = [""]
    for c in motif.upper():
        forms = [f + x for f in forms for x in IUPAC[c]]
    return forms


def mismatches_at(seq: Column, motif: str, start: Column) -> Column:
    """Letters of a motif (IUPAC) that differ from seq at 1-based start; the motif's length where seq ends before."""
    wrong = [(~F.substring(seq, start + i, F.lit(1)).isin(*(IUPAC[c] + c))).cast("int") for i, c in enumerate(motif.upper())]
    return F.when(F.length(seq) >= start + len(motif) - 1, sum(wrong[1:], wrong[0])).otherwise(F.lit(len(motif)))
