"""Binary formats: BAM alignments and 2bit genomes.

BAM is a Python data source: its partitions are files, each streamed block by block (BGZF), so no file
is held in memory. 2bit files are read whole by file (a genome's file), one row a chromosome.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rowid bigint, name string, chrom string, pos bigint, mapq int, cigar string, mate_chrom string, mate_pos bigint, insert_size int, seq string, qual array<int>, mapped boolean, mate_mapped boolean, reverse boolean, primary boolean, paired boolean, proper boolean"
#: The letters of BAM's 4-bit bases and CIGAR operations.
NIBBLES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def unzipped(path: str) -> Iterator[bytes]:
    """The content of a file of concatenated gzip members, in pieces."""
    with open(path, "rb") as f:
        z, rest = zlib.decompressobj(31), b""
        while chunk := rest or f.read(1 << 20):
            yield z.decompress(chunk)
            rest = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


class Stream:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return None
            self.held += piece
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def header(s: Stream) -> list[tuple[str, int]]:
    """Names and lengths of a BAM's references."""
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", s.take(4))[0]))
    return refs


def alignments(path: str) -> Iterator[tuple]:
    s = Stream(unzipped(path))
    refs = header(s)
    name_of = lambda k: refs[k][0] if k >= 0 else None
    number = 0
    while (head := s.take(4)) is not None:
        b = s.take(struct.unpack("<i", head)[0])
        ref, pos, bin_mq_nl, flag_nc, size, mref, mpos, tlen = struct.unpack("<iiIIiiii", b[:32])
        n_name, mapq, n_cigar, flag = bin_mq_nl & 255, (bin_mq_nl >> 8) & 255, flag_nc & 0xFFFF, flag_nc >> 16
        at = 32 + n_name
        cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack(f"<{n_cigar}I", b[at : at + 4 * n_cigar]))
        at += 4 * n_cigar
        seq = "".join(NIBBLES[x >> 4] + NIBBLES[x & 15] for x in b[at : at + (size + 1) // 2])[:size]
        at += (size + 1) // 2
        qual = list(b[at : at + size])
        yield (number, b[32 : 32 + n_name - 1].decode(), name_of(ref), pos if pos >= 0 else None, mapq, cigar or None, name_of(mref), mpos if mpos >= 0 else None, tlen, seq, None if qual and qual[0] == 255 else qual, not flag & 4, bool(flag & 1 and not flag & 8), bool(flag & 16), not flag & 2304, bool(flag & 1), bool(flag & 2))
        number += 1


class BamReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        yield from alignments(partition.value)


class BamSource(DataSource):
    """format('bam'), option path: files or patterns, separated by commas, that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        import glob

        return BamReader(sorted(f for p in self.options["path"].split(",") for f in glob.glob(p)))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("path", path).load()


def bam_references(path: str) -> list[tuple[str, int]]:
    return header(Stream(unzipped(path)))


def two_bit_sequences(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, sequence) of a 2bit file: masked stretches in lower case, unknown ones as N."""
    import numpy as np

    order = "<" if struct.unpack("<I", data[:4])[0] == 0x1A412743 else ">"
    count = struct.unpack(order + "I", data[8:12])[0]
    at = 16
    for _ in range(count):
        n = data[at]
        name = data[at + 1 : at + 1 + n].decode()
        where = struct.unpack(order + "I", data[at + 1 + n : at + 5 + n])[0]
        at += 5 + n

        def numbers(p: int, k: int) -> tuple[int, ...]:
            return struct.unpack(f"{order}{k}I", data[p : p + 4 * k])

        size, n_blocks = numbers(where, 2)
        p = where + 8
        starts, sizes = numbers(p, n_blocks), numbers(p + 4 * n_blocks, n_blocks)
        p += 8 * n_blocks
        m_blocks = numbers(p, 1)[0]
        m_starts, m_sizes = numbers(p + 4, m_blocks), numbers(p + 4 + 4 * m_blocks, m_blocks)
        p += 8 + 8 * m_blocks
        packed = np.frombuffer(data, np.uint8, (size + 3) // 4, p)
        codes = np.stack([(packed >> s) & 3 for s in (6, 4, 2, 0)], axis=1).ravel()[:size]
        letters = np.frombuffer(b"TCAG", np.uint8)[codes].copy()
        for a, k in zip(starts, sizes, strict=True):
            letters[a : a + k] = ord("N")
        for a, k in zip(m_starts, m_sizes, strict=True):
            letters[a : a + k] |= 32
        yield name, letters.tobytes().decode()


def read_two_bit(spark: SparkSession, path: str) -> DataFrame:
    """(file, chrom, seq) of 2bit files."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, seq in two_bit_sequences(bytes(content)):
                    yield pd.DataFrame([(file, name, seq)], columns=["file", "chrom", "seq"])

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInPandas(rows, "file string, chrom string, seq string")
