"""Binary sources as Spark data sources: BAM alignments and BigWig tracks. register() makes the formats known to a session.

A BAM file is read in splits of bytes, whose first records are found and checked (BamFile). A BigWig file is read by one task
per chromosome through its index.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from anchorspan.session import ship

#: Fixed values of the formats.
BAM_BASES = "=ACMGRSVTWYHKDBN"
BAM_OPERATIONS = "MIDNSHP=X"
BIGWIG_MAGIC = 0x888FFC26
#: Bytes that are packed into one block of the blocked gzip format.
BGZF_BYTES = 60_000
BAM_MAGIC, CHROM_TREE, R_TREE = "BAM\1", 0x78CA8C91, 0x2468ACE0
SAM_SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags array<string>, file string, block bigint, at bigint"
WIG_SCHEMA = "chrom string, start bigint, end bigint, value double, file string, at bigint"
_PAIRS = [BAM_BASES[b >> 4] + BAM_BASES[b & 15] for b in range(256)]
_QUALITY = bytes((b + 33) & 255 for b in range(256))
_NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}


#: Bytes of a BAM file that one task reads; the option splitBytes names another size.
SPLIT_BYTES = 16 << 20
#: Rows that a reader hands over at once.
ROWS = 4096


class FilePart(InputPartition):
    def __init__(self, path: str, chrom: tuple | None = None, begin: int = 0, end: int = 0):
        self.path, self.chrom, self.begin, self.end = path, chrom, begin, end


def _files(path: str, suffix: str) -> list[str]:
    path = path.removeprefix("file:")
    return sorted(glob.glob(os.path.join(path, f"*{suffix}"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]


def _tags(data: bytes) -> list[str]:
    out, i = [], 0
    while i + 3 <= len(data):
        name, kind = data[i : i + 2].decode("latin-1"), chr(data[i + 2])
        i += 3
        if kind in "ZH":
            end = data.index(0, i)
            out.append(f"{name}:{kind}:{data[i:end].decode('latin-1')}")
            i = end + 1
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[i])}")
            i += 1
        elif kind == "B":
            sub, count = chr(data[i]), struct.unpack_from("<i", data, i + 1)[0]
            form = "<" + ("f" if sub == "f" else _NUMBER[sub]) * count
            out.append(f"{name}:B:{sub}," + ",".join(f"{x:g}" if sub == "f" else str(x) for x in struct.unpack_from(form, data, i + 5)))
            i += 5 + struct.calcsize(form)
        else:
            form = "<f" if kind == "f" else "<" + _NUMBER[kind]
            value = struct.unpack_from(form, data, i)[0]
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{value:g}" if kind == "f" else f"{name}:i:{value}")
            i += struct.calcsize(form)
    return out


def _block_size(head: bytes) -> int:
    """The size of the block of the blocked gzip format that begins with these bytes; 0 if they begin none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    fields, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 6 <= len(fields):
        if fields[at : at + 4] == b"BC\2\0":
            return struct.unpack_from("<H", fields, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", fields, at + 2)[0]
    return 0


class BamFile:
    """A BAM file: its header, and its records by ranges of bytes.

    A record belongs to the range in which its block begins. The first record of a range is found by a chain of records that
    all are sound; the range before checks it, as its own chain must end there, so a wrong place raises and never gives rows.
    """

    def __init__(self, path: str):
        self.path = path
        self.file = open(path, "rb")  # noqa: SIM115
        self.length = os.fstat(self.file.fileno()).st_size
        self.blocked = _block_size(self.file.read(64)) > 0
        self.data, self.marks, self.next = bytearray(), [], 0
        with gzip.open(path, "rb") as f:
            take = lambda form: struct.unpack(form, f.read(struct.calcsize(form)))
            if f.read(4) != BAM_MAGIC.encode("latin-1"):
                raise ValueError(f"{path} is no BAM file")
            self.text = f.read(take("<i")[0])
            self.names, sizes = [], []
            for _ in range(take("<i")[0]):
                self.names.append(f.read(take("<i")[0])[:-1].decode("latin-1"))
                sizes.append(take("<i")[0])
            self.sizes, self.head = np.array(sizes, dtype=np.int64), f.tell()

    # The data of consecutive blocks, read as far as it is asked for; marks are (where a block's data begins, the block's place).
    def _open(self, place: int) -> None:
        self.data, self.marks, self.next = bytearray(), [], place

    def _more(self) -> bool:
        if not self.blocked:  # one stream: the whole file is one block
            if self.marks:
                return False
            with gzip.open(self.path, "rb") as f:
                self.data, self.marks = bytearray(f.read()), [(0, 0)]
            return True
        while self.next < self.length:
            self.file.seek(self.next)
            size = _block_size(head := self.file.read(64))
            if not size:
                raise ValueError(f"{self.path}: no block at byte {self.next}")
            body = head + self.file.read(max(0, size - len(head)))
            data = zlib.decompress(body[12 + struct.unpack_from("<H", body, 10)[0] : size - 8], -15)
            self.marks.append((len(self.data), self.next))
            self.next += size
            self.data += data
            if data:
                return True
            self.marks.pop()
        return False

    def _has(self, end: int) -> bool:
        while len(self.data) < end:
            if not self._more():
                return False
        return True

    def _place(self, at: int) -> tuple[int, int]:
        """(block, place within it) of a place in the data; what lies at a block's end is the begin of the next one."""
        if not self._has(at + 1):
            return self.length, 0
        begin, block = self.marks[bisect_right(self.marks, (at, self.length)) - 1]
        return block, at - begin

    def _sound(self, at: int) -> int:
        """Where the record at this place ends, if it is one; else 0. -1: the data ends within it."""
        if not self._has(at + 36):
            return -1 if len(self.data) == at else 0
        size, ref, pos, name_size, _, _, n_ops, _, n_bases, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", self.data, at)
        n = len(self.names)
        if not (-1 <= ref < n and -1 <= mate < n and -1 <= pos and -1 <= mate_pos and name_size and n_bases >= 0 and 32 + name_size + 4 * n_ops + (n_bases + 1) // 2 + n_bases <= size < 1 << 29):
            return 0
        if ref >= 0 and pos > self.sizes[ref] or mate >= 0 and mate_pos > self.sizes[mate] or not self._has(at + 4 + size):
            return 0
        name = self.data[at + 36 : at + 36 + name_size]
        ops = self.data[at + 36 + name_size : at + 36 + name_size + 4 * n_ops : 4]
        return at + 4 + size if name[-1] == 0 and all(33 <= c < 127 for c in name[:-1]) and all(o & 15 < len(BAM_OPERATIONS) for o in ops) else 0

    def first(self, begin: int) -> tuple[int, int]:
        """(block, place within it) of the first record whose block begins at or behind this byte; (length, 0) if there is none."""
        if begin <= 0:
            self._open(0)
            return self._place(self.head)
        place = begin
        while place < self.length:  # the first place at which a block begins, and behind which another one does
            self.file.seek(place)
            window = self.file.read(1 << 17)
            found = window.find(b"\x1f\x8b\x08\x04")
            while found >= 0:
                size = _block_size(window[found : found + 64])
                self.file.seek(place + found + size)
                if size and (place + found + size == self.length or _block_size(self.file.read(64))):
                    break
                found = window.find(b"\x1f\x8b\x08\x04", found + 1)
            if found >= 0:
                place += found
                break
            place += max(1, len(window) - 63)
        if place >= self.length:
            return self.length, 0
        self._open(place)
        at = 0
        while self._has(at + 36):
            arrays = np.frombuffer(bytes(self.data[at:]), dtype=np.uint8)
            k = np.arange(len(arrays) - 35)
            number = lambda o: (arrays[k + o].astype(np.int64) | arrays[k + o + 1].astype(np.int64) << 8 | arrays[k + o + 2].astype(np.int64) << 16 | arrays[k + o + 3].astype(np.int8).astype(np.int64) << 24)  # noqa: B023, E731
            ref, mate = number(4), number(24)
            for u in np.flatnonzero((number(0) >= 34) & (ref >= -1) & (ref < len(self.names)) & (mate >= -1) & (mate < len(self.names))).tolist():
                end, count = self._sound(at + u), 1
                while end > 0 and count < 64:
                    end, count = self._sound(end), count + 1
                if end:
                    return self._place(at + u)
            at += len(k)
        return self.length, 0

    def records(self, begin: int = 0, end: int | None = None) -> Iterator[tuple]:
        """The records of a range of bytes as rows of SAM_SCHEMA; ``at`` is their place in the file."""
        end = self.length if end is None or not self.blocked else end
        block, inner = self.first(begin)
        if block < end:
            self._open(block)
            at = inner
            while self._has(at + 4) and (found := self._place(at))[0] < end:
                size = struct.unpack_from("<i", self.data, at)[0]
                if not self._has(at + 4 + size):
                    raise ValueError(f"{self.path} ends within a record")
                yield self._row(bytes(self.data[at + 4 : at + 4 + size]), found[0] << 16 | found[1])
                at += 4 + size
                if at > 1 << 22:  # what is done with goes
                    k = bisect_right(self.marks, (at, self.length)) - 1
                    gone = self.marks[k][0]
                    del self.data[:gone]
                    self.marks, at = [(b - gone, p) for b, p in self.marks[k:]], at - gone
            block, inner = self._place(at)
        if begin < end < self.length and self.first(end) != (block, inner) and block >= end:
            raise ValueError(f"{self.path}: records can't be told apart at byte {end}; read it without splits")

    def _row(self, data: bytes, at: int) -> tuple:
        ref, pos, name_size, mapq, _bin, n_ops, flag, n_bases, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        i = 32
        qname = data[i : i + name_size - 1].decode("latin-1")
        i += name_size
        ops = struct.unpack_from(f"<{n_ops}I", data, i)
        i += 4 * n_ops
        packed = data[i : i + (n_bases + 1) // 2]
        i += len(packed)
        seq = "".join(map(_PAIRS.__getitem__, packed))[:n_bases] or "*"
        raw = data[i : i + n_bases]
        i += n_bases
        qual = "*" if not raw or raw[0] == 255 else raw.translate(_QUALITY).decode("latin-1")
        name = lambda k: self.names[k] if k >= 0 else "*"
        mate_name = "=" if mate == ref and mate >= 0 else name(mate)
        return qname, flag, name(ref), pos, mapq, "".join(f"{o >> 4}{BAM_OPERATIONS[o & 15]}" for o in ops) or "*", mate_name, mate_pos, tlen, seq, qual, _tags(data[i:]), self.path, 0, at


def read_bam(path: str) -> Iterator[tuple]:
    """The records of a BAM file as rows of SAM_SCHEMA, one after the other."""
    return BamFile(path).records()


def bam_header(path: str) -> list[str]:
    """The header lines of a BAM file."""
    return BamFile(path).text.rstrip(b"\0").decode("utf-8", "replace").splitlines()


def _bgzf(data: bytes) -> bytes:
    """One block of the blocked gzip format."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _packed_tag(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    head = name.encode("latin-1")
    if kind == "A":
        return head + b"A" + value.encode("latin-1")
    if kind == "i":
        return head + (b"i" + struct.pack("<i", int(value)) if int(value) < 1 << 31 else b"I" + struct.pack("<I", int(value)))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        sub, *items = value.split(",")
        form = "f" if sub == "f" else _NUMBER[sub]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(items)}{form}", len(items), *[float(x) if sub == "f" else int(x) for x in items])
    return head + kind.encode() + value.encode("latin-1") + b"\0"


def _bin_of(start: int, end: int) -> int:
    """The least bin of the binning scheme that holds [start, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def packed_read(line: str, number: dict[str, int]) -> bytes:
    """The binary record of an alignment line. number: the place of each sequence in the header."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, *tags = line.split("\t")
    ops = [(int(n), BAM_OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    span = sum(n for n, o in ops if BAM_OPERATIONS[o] in "MDN=X") or 1
    start, ref = int(pos) - 1, number.get(rname, -1)
    bases = "" if seq == "*" else seq.upper()
    codes = [max(0, BAM_BASES.find(b)) if b in BAM_BASES else 15 for b in bases] + [0] * (len(bases) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, start, len(qname) + 1, int(mapq), _bin_of(max(start, 0), max(start, 0) + span), len(ops), int(flag), len(bases), ref if rnext == "=" else number.get(rnext, -1), int(pnext) - 1, int(tlen))
    body += qname.encode("latin-1") + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += b"\xff" * len(bases) if qual == "*" else bytes(ord(q) - 33 for q in qual)
    body += b"".join(map(_packed_tag, tags))
    return struct.pack("<i", len(body)) + body


def _sequences(header: list[str]) -> dict[str, int]:
    """The sequences of header lines with their length, in order."""
    fields = [dict(p.split(":", 1) for p in x.split("\t")[1:]) for x in header if x.startswith("@SQ")]
    return {f["SN"]: int(f["LN"]) for f in fields}


def bam_blocks(lines: Iterable[str], number: dict[str, int]) -> Iterator[bytes]:
    """The packed blocks of alignment lines; records may cross their borders."""
    held = b""
    for line in lines:
        held += packed_read(line, number)
        while len(held) >= BGZF_BYTES:
            yield _bgzf(held[:BGZF_BYTES])
            held = held[BGZF_BYTES:]
    if held:
        yield _bgzf(held)


def bam_file(header: list[str], blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a BAM file: its header, the blocks of its records, and the empty block that ends it."""
    sequences, text = _sequences(header), "".join(x + "\n" for x in header).encode()
    held = BAM_MAGIC.encode("latin-1") + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sequences))
    for name, size in sequences.items():
        held += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for i in range(0, len(held), BGZF_BYTES):
        yield _bgzf(held[i : i + BGZF_BYTES])
    yield from blocks
    yield _bgzf(b"")


def packed_bam(lines: DataFrame, header: list[str]) -> DataFrame:
    """(data): the blocks of a column ``line`` of alignment lines, packed by its tasks."""
    number = {name: i for i, name in enumerate(_sequences(header))}
    ship(lines.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in bam_blocks((x for batch in batches for x in batch.column(0).to_pylist()), number):
            yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.binary())], names=["data"])

    return lines.mapInArrow(pack, "data binary")


def write_bam(path: str, header: list[str], lines: Iterable[str]) -> None:
    """Writes header and alignment lines as a BAM file, block by block."""
    number = {name: i for i, name in enumerate(_sequences(header))}
    with open(path, "wb") as f:
        f.writelines(bam_file(header, bam_blocks(lines, number)))


class BigWig:
    """Reads a BigWig file: its chromosomes through the name tree, their intervals through the R-tree."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        head = self.file.read(64)
        self.order = "<" if struct.unpack("<I", head[:4])[0] == BIGWIG_MAGIC else ">"
        if struct.unpack(self.order + "I", head[:4])[0] != BIGWIG_MAGIC:
            raise ValueError(f"{path} is no BigWig file")
        _magic, _version, _zooms, self.chrom_at, _data, self.index_at, *_rest, self.packed, _ext = struct.unpack(self.order + "IHHQQQHHQQIQ", head)

    def take(self, at: int, form: str) -> tuple:
        self.file.seek(at)
        return struct.unpack(self.order + form, self.file.read(struct.calcsize(self.order + form)))

    def chroms(self) -> list[tuple[str, int, int]]:
        """(name, id, size), by id."""
        magic, _block, key_size, _value, _count, _ = self.take(self.chrom_at, "IIIIQQ")
        if magic != CHROM_TREE:
            raise ValueError("no chromosome tree")
        out, todo = [], [self.chrom_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, count = self.take(at, "BBH")
            for k in range(count):
                if leaf:
                    key, number, size = self.take(at + 4 + k * (key_size + 8), f"{key_size}sII")
                    out.append((key.rstrip(b"\0").decode(), number, size))
                else:
                    todo.append(self.take(at + 4 + k * (key_size + 8), f"{key_size}sQ")[1])
        return sorted(out, key=lambda c: c[1])

    def intervals(self, chrom: int) -> Iterator[tuple[int, int, float]]:
        """(start, end, value) of a chromosome in file order."""
        if self.take(self.index_at, "I")[0] != R_TREE:
            raise ValueError("no index")
        todo = [self.index_at + 48]
        while todo:
            at = todo.pop(0)
            leaf, _, count = self.take(at, "BBH")
            below = []
            for k in range(count):
                if leaf:
                    first, _, last, _, where, size = self.take(at + 4 + 32 * k, "IIIIQQ")
                    if first <= chrom <= last:
                        yield from self._block(where, size, chrom)
                else:
                    first, _, last, _, child = self.take(at + 4 + 24 * k, "IIIIQ")
                    if first <= chrom <= last:
                        below.append(child)
            todo = below + todo

    def _block(self, at: int, size: int, chrom: int) -> Iterator[tuple[int, int, float]]:
        self.file.seek(at)
        data = self.file.read(size)
        if self.packed:
            data = zlib.decompress(data)
        number, start, _end, step, span, kind, _, count = struct.unpack_from(self.order + "IIIIIBBH", data)
        if number != chrom:
            return
        if kind == 1:
            yield from struct.iter_unpack(self.order + "IIf", data[24 : 24 + 12 * count])
        elif kind == 2:
            for pos, value in struct.iter_unpack(self.order + "If", data[24 : 24 + 8 * count]):
                yield pos, pos + span, value
        else:
            for k, (value,) in enumerate(struct.iter_unpack(self.order + "f", data[24 : 24 + 4 * count])):
                yield start + k * step, start + k * step + span, value


#: What is known of a packed block of a BigWig file: its chromosome's number, first and last place, records, bases, and least, largest, sum and square sum of values by base.
BLOCK_SCHEMA = "number bigint, first bigint, last bigint, bases bigint, least double, largest double, total double, squares double, raw bigint, packed bigint, data binary"


def bigwig_blocks(records: Iterable[tuple[int, int, int, float]], per_block: int = 1024) -> Iterator[tuple]:
    """Rows of BLOCK_SCHEMA of sorted, disjoint (chromosome number, start, end, value), up to per_block records of a chromosome each."""
    for number, of_chrom in groupby(records, key=lambda r: r[0]):
        while part := list(islice(of_chrom, per_block)):
            body = struct.pack("<IIIIIBBH", number, part[0][1], part[-1][2], 0, 0, 1, 0, len(part)) + b"".join(struct.pack("<IIf", *r[1:]) for r in part)
            data, sizes, values = zlib.compress(body), [e - s for _, s, e, _ in part], [r[3] for r in part]
            sums = [sum(n * v**p for n, v in zip(sizes, values, strict=True)) for p in (1, 2)]
            yield number, part[0][1], part[-1][2], sum(sizes), min(values), max(values), *sums, len(body), len(data), data


def _index(places: list[tuple[int, int, int, int, int]], at: int, fan: int = 256) -> bytes:
    """The R-tree of (number, first, last, place, size) of blocks, which begins at ``at``: levels of nodes from the root down to the leaves."""
    levels = [[places[i : i + fan] for i in range(0, len(places), fan)] or [[]]]
    spans = lambda node: (*node[0][:2], node[-1][0], max(x[2] for x in node if x[0] == node[-1][0])) if node else (0, 0, 0, 0)
    bounds = [[spans(node) for node in levels[0]]]
    while len(levels[-1]) > 1:
        below = bounds[-1]
        levels.append([list(range(i, min(i + fan, len(below)))) for i in range(0, len(below), fan)])
        bounds.append([(*below[node[0]][:2], *max(below[k][2:] for k in node)) for node in levels[-1]])
    root = bounds[-1][0]
    out = struct.pack("<IIQIIIIQII", R_TREE, fan, len(places), *root, at, 1, 0)
    begin = at + len(out)
    for depth in range(len(levels) - 1, -1, -1):
        sizes = [4 + (24 if depth else 32) * len(node) for node in levels[depth]]
        child = begin + sum(sizes)
        for node in levels[depth]:
            out += struct.pack("<BBH", int(not depth), 0, len(node))
            for x in node:
                if depth:
                    out += struct.pack("<IIIIQ", *bounds[depth - 1][x], child)
                    child += 4 + (24 if depth > 1 else 32) * len(levels[depth - 1][x])
                else:
                    out += struct.pack("<IIIIQQ", x[0], x[1], x[0], x[2], x[3], x[4])
        begin += sum(sizes)
    return out


def bigwig_file(size_of: dict[str, int], blocks: list[tuple], data: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a BigWig file without zoom levels. blocks: rows of BLOCK_SCHEMA in order, without their data, which follows in the same order."""
    names = sorted(size_of)
    key = max(map(len, names), default=1)
    chrom_at = 64 + 40
    tree = struct.pack("<IIIIQQ", CHROM_TREE, max(1, len(names)), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)) + b"".join(struct.pack(f"<{key}sII", n.encode(), i, size_of[n]) for i, n in enumerate(names))
    data_at = chrom_at + len(tree)
    ends = list(accumulate((b[9] for b in blocks), initial=data_at + 8))
    places = [(b[0], b[1], b[2], at, b[9]) for b, at in zip(blocks, ends, strict=False)]
    sums = [sum(b[k] for b in blocks) for k in (3, 6, 7)]
    yield struct.pack("<IHHQQQHHQQIQ", BIGWIG_MAGIC, 4, 0, chrom_at, data_at, ends[-1], 0, 0, 0, 64, max((b[8] for b in blocks), default=0), 0)
    yield struct.pack("<Qdddd", sums[0], min((b[4] for b in blocks), default=0.0), max((b[5] for b in blocks), default=0.0), *sums[1:])
    yield tree + struct.pack("<Q", len(blocks))
    yield from data
    yield _index(places, ends[-1])
    yield struct.pack("<I", BIGWIG_MAGIC)


def packed_bigwig(records: DataFrame, names: list[str]) -> DataFrame:
    """Rows of BLOCK_SCHEMA of disjoint (chrom, start, end, value), packed by tasks that hold a range of places each. names: all chromosomes, sorted."""
    number = {n: i for i, n in enumerate(names)}
    ship(records.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((number[c], s, e, v) for batch in batches for c, s, e, v in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        schema = pa.schema([(n, {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in BLOCK_SCHEMA.split(", "))])
        for block in bigwig_blocks(rows):
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(block, schema, strict=True)], schema=schema)

    return records.select("chrom", "start", "end", "value").repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").mapInArrow(pack, BLOCK_SCHEMA)


def write_bigwig(path: str, sizes: list[tuple[str, int]], records: list[tuple[str, int, int, float]], per_block: int = 1024) -> None:
    """Writes disjoint (chrom, start, end, value) in hand as a BigWig file."""
    number = {n: i for i, n in enumerate(sorted(n for n, _ in sizes))}
    blocks = list(bigwig_blocks(sorted((number[c], s, e, v) for c, s, e, v in records), per_block))
    with open(path, "wb") as f:
        f.writelines(bigwig_file(dict(sizes), [b[:-1] for b in blocks], [b[-1] for b in blocks]))


class BamSource(DataSource):
    """spark.read.format("bam").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SAM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], ".bam", int(self.options.get("splitBytes", SPLIT_BYTES)))


class BigWigSource(DataSource):
    """spark.read.format("bigwig").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return WIG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], ".bw")


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split: int = SPLIT_BYTES):
        self.path, self.suffix, self.split = path, suffix, split

    def partitions(self) -> list[InputPartition]:
        files = _files(self.path, self.suffix)
        if self.suffix != ".bam":
            return [FilePart(p, c) for p in files for c in BigWig(p).chroms()]
        sizes = {p: os.path.getsize(p) if BamFile(p).blocked else 1 for p in files}
        return [FilePart(p, begin=at, end=min(at + self.split, size)) for p, size in sizes.items() for at in range(0, size, self.split)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        rows = BamFile(partition.path).records(partition.begin, partition.end) if partition.chrom is None else self._intervals(partition)
        names, kinds = zip(*(f.split(" ", 1) for f in (SAM_SCHEMA if partition.chrom is None else WIG_SCHEMA).split(", ")), strict=True)
        kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))

    def _intervals(self, partition: FilePart) -> Iterator[tuple]:
        name, number, _ = partition.chrom
        for at, (start, end, value) in enumerate(BigWig(partition.path).intervals(number)):
            yield name, start, end, float(value), partition.path, number << 40 | at


def register(spark: SparkSession) -> None:
    """Makes the formats bam and bigwig known to the session."""
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BigWigSource)
