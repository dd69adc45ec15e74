"""Made-up object files of both widths and byte orders."""

import struct

import pytest

from kitefin.sources import elf, graphs

SECTIONS = ["", ".init.text", "__ksymtab_strings", ".text", ".symtab", ".strtab", ".shstrtab"]


def made(wide, big, symbols, sections=SECTIONS, extended=False):
    """An object file with symbols (name, section index)."""
    order = ">" if big else "<"
    strings, at = b"\0", {}
    for name, _ in symbols:
        if name not in at:
            at[name] = len(strings) if name else 0
            strings += name.encode() + b"\0" if name else b""
    headers, places = b"\0", {}
    for s in sections:
        places[s] = len(headers)
        headers += s.encode() + b"\0"
    table = b""
    for name, index in [("", 0), *symbols]:
        table += struct.pack(order + "IBBHQQ", at.get(name, 0), 2, 0, index, 0, 0) if wide else struct.pack(order + "IIIBBH", at.get(name, 0), 0, 0, 2, 0, index)
    start = 64 if wide else 52
    bodies = {".symtab": table, ".strtab": strings, ".shstrtab": headers}
    body, spans = b"", {}
    for name, content in bodies.items():
        spans[name] = (start + len(body), len(content))
        body += content
    rows = b""
    for s in sections:
        off, size = spans.get(s, (start, 0))
        kind = {".symtab": 2, ".strtab": 3, ".shstrtab": 3, "": 0}.get(s, 1)
        link = sections.index(".strtab") if s == ".symtab" else 0
        entry = (24 if wide else 16) if s == ".symtab" else 0
        rows += struct.pack(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), places[s], kind, 0, 0, off, size, link, 0, 0, entry)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 2 if big else 1, 1]) + b"\0" * 9
    rest = struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 1, 62, 1, 0, 0, start + len(body), 0, start, 0, 0, 64 if wide else 40, len(sections), sections.index(".shstrtab"))
    return ident + rest + body + rows


SYMBOLS = [("init_me", 1), ("__kstrtab_shown", 2), ("my_trace_fn", 3), ("__x64_sys_open", 3), ("undefined", 0), ("absolute", 0xFFF1), ("größe", 3), ("", 3)]
WANT = [("init_me", ".init.text"), ("__kstrtab_shown", "__ksymtab_strings"), ("my_trace_fn", ".text"), ("__x64_sys_open", ".text"), ("undefined", None), ("absolute", None), ("größe", ".text")]


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("big", [True, False])
def test_symbols(wide, big):
    assert elf.symbols(made(wide, big, SYMBOLS)) == WANT


def test_what_is_no_elf_or_broken():
    whole = made(True, False, SYMBOLS)
    assert elf.symbols(b"") == [] and elf.symbols(b"\x7fELF" + b"\1" * 80) == [] and elf.symbols(b"#!/bin/sh\n" * 20) == []
    for n in range(0, len(whole), 7):
        assert set(elf.symbols(whole[:n])) <= set(WANT) | {(name, None) for name, _ in WANT}


def test_read_and_classify(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "vmlinux").write_bytes(made(True, False, SYMBOLS))
    (tmp_path / "part.o").write_bytes(made(False, True, [("init_alone", 1)], [s for s in SECTIONS if s != "__ksymtab_strings"]))
    (tmp_path / "notes.txt").write_text("init_not")
    found = elf.elf_symbols(spark, str(tmp_path))
    assert found.count() == len(WANT) + 1
    labels = sorted((r.label, r.name) for r in graphs.classify_symbols(found).collect())
    assert labels == [("EXPORT", "shown"), ("INIT", "init_me"), ("SYSCALL", "__x64_sys_open"), ("TRACE", "my_trace_fn")]
