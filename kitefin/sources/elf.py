"""Symbols of ELF object files, read as binary files: (file, name, section), what `classify_symbols` takes.

Headers, section table, symbol tables and their strings are read by offset; of a file only those are looked at. Files of
either width and byte order are taken; what isn't ELF has no symbols.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the ELF format.
MAGIC = b"\x7fELF"
SYMTAB, DYNSYM, NOBITS = 2, 11, 8
UNDEFINED, RESERVED, EXTENDED = 0, 0xFF00, 0xFFFF
SYMTAB_SHNDX = 18


def _string(data: memoryview, at: int, end: int) -> str:
    if at >= end:
        return ""
    raw = bytes(data[at : min(end, at + 4096)])
    while b"\0" not in raw and at + len(raw) < end:
        raw += bytes(data[at + len(raw) : min(end, at + len(raw) + 65536)])
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def symbols(content: bytes, dynamic: bool = False) -> list[tuple[str, str | None]]:
    """(name, section) of the named symbols; section is null for undefined, absolute and common ones.

    Truncated tables end where the file does. dynamic: of the dynamic symbol table instead.
    """
    data = memoryview(content)
    if len(data) < 52 or bytes(data[:4]) != MAGIC or data[4] not in (1, 2) or data[5] not in (1, 2):
        return []
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    if wide and len(data) < 64:
        return []
    offset = struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
    size, count, names = struct.unpack_from(order + "HHH", data, 58 if wide else 46)
    form = order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII")
    if not offset or size < struct.calcsize(form):
        return []

    def section(k: int) -> tuple | None:
        at = offset + k * size
        return struct.unpack_from(form, data, at) if at + struct.calcsize(form) <= len(data) else None

    zero = section(0)
    if zero is None:
        return []
    count, names = count or zero[5], zero[6] if names == EXTENDED else names
    table = [s for s in (section(k) for k in range(count)) if s is not None]
    if names >= len(table):
        return []
    span = lambda s: (s[4], s[4] if s[1] == NOBITS else min(len(data), s[4] + s[5]))
    start, end = span(table[names])
    called = [_string(data, start + s[0], end) for s in table]
    out: list[tuple[str, str | None]] = []
    entry = struct.Struct(order + ("IBBHQQ" if wide else "IIIBBH"))
    for k, s in enumerate(table):
        if s[1] != (DYNSYM if dynamic else SYMTAB) or s[6] >= len(table):
            continue
        strings, strings_end = span(table[s[6]])
        extended = next((span(x) for x in table if x[1] == SYMTAB_SHNDX and x[6] == k), None)
        first, last = span(s)
        step = s[9] or entry.size
        for n, at in enumerate(range(first, last - entry.size + 1, step)):
            fields = entry.unpack_from(data, at)
            index = fields[3] if wide else fields[5]
            if index == EXTENDED and extended and extended[0] + 4 * n + 4 <= extended[1]:
                index = struct.unpack_from(order + "I", data, extended[0] + 4 * n)[0]
            elif index >= RESERVED:
                index = UNDEFINED
            if name := _string(data, strings + fields[0], strings_end):
                out.append((name, called[index] if 0 < index < len(called) else None))
    return out


def elf_symbols(spark: SparkSession, path: str, glob: str = "*", dynamic: bool = False) -> DataFrame:
    """file, name, section of all object files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = symbols(content.as_py() or b"", dynamic)
                if found:
                    names, sections = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sections, pa.string())], names=["file", "name", "section"])

    return files.select("path", F.col("content")).mapInArrow(run, "file string, name string, section string")
