"""Cells of the first sheet of an older workbook (BIFF8 records in a compound file), as text.

A sheet of this format has at most 65 536 rows of 256 columns, so a workbook is parsed in one
task.  What isn't BIFF8 (older records, encrypted books) is refused with a ``ValueError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed values of the two formats: the signature, marks of chains and the record numbers used here.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
CHAIN_ENDS = 0xFFFFFFFA
BOF, EOF, CONTINUE, FILEPASS, BOUNDSHEET, SST = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC
LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def stream(content: bytes, names: tuple[str, ...]) -> bytes:
    """The stream of a compound file that has one of the names."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a compound file")
    shift, mini_shift = struct.unpack_from("<2H", content, 30)
    n_fat, first_dir = struct.unpack_from("<2I", content, 44)
    cutoff, first_mini, _, difat, n_difat = struct.unpack_from("<5I", content, 56)
    each = 1 << shift

    def sector(k: int) -> bytes:
        return content[(k + 1) << shift : (k + 2) << shift]

    def numbers(b: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))

    where = numbers(content[76:512])
    for _ in range(n_difat):
        *more, difat = numbers(sector(difat))
        where += more
    fat = [x for k in where[:n_fat] for x in numbers(sector(k))]

    def chain(k: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table)):
            if k >= CHAIN_ENDS:
                return
            yield k
            k = table[k]

    def whole(k: int) -> bytes:
        return b"".join(sector(x) for x in chain(k, fat))

    listing = whole(first_dir)
    entries = {}
    for at in range(0, len(listing), 128):
        length, kind = struct.unpack_from("<HB", listing, at + 64)
        if kind in (2, 5):
            start, size = struct.unpack_from("<2I", listing, at + 116)
            entries["" if kind == 5 else listing[at : at + max(0, length - 2)].decode("utf-16-le")] = (start, size)
    found = next((entries[n] for n in names if n in entries), None)
    if found is None:
        raise ValueError(f"no stream {' or '.join(names)}")
    start, size = found
    if size >= cutoff:
        return b"".join(content[(k + 1) * each : (k + 2) * each] for k in chain(start, fat))[:size]
    small, table = whole(entries[""][0]), numbers(whole(first_mini))
    return b"".join(small[k << mini_shift : (k + 1) << mini_shift] for k in chain(start, table))[:size]


def records(book: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """Number and content of the records of a substream, up to its end; substreams within it (charts) are left out."""
    depth = 0
    while at + 4 <= len(book):
        kind, length = struct.unpack_from("<2H", book, at)
        depth += (kind == BOF) - (kind == EOF)
        if depth <= 0:
            return
        if depth == 1:
            yield kind, book[at + 4 : at + 4 + length]
        at += 4 + length


def shared_strings(parts: list[bytes]) -> list[str]:
    """The table of strings; characters of a string cut at a record's end go on after a byte that tells their width anew."""
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        out = b""
        while n and part < len(parts):
            got = parts[part][at : at + n]
            out, at, n = out + got, at + len(got), n - len(got)
            if n:
                part, at = part + 1, 0
        return out

    def characters(n: int, wide: int) -> str:
        nonlocal part, at
        out = ""
        while True:
            width = 1 + wide
            got = parts[part][at : at + min(n, (len(parts[part]) - at) // width) * width]
            out += got.decode("utf-16-le" if wide else "latin-1", "replace")
            at, n = at + len(got), n - len(got) // width
            if not n or part + 1 >= len(parts):
                return out
            part, at, wide = part + 1, 1, parts[part + 1][0] & 1

    strings = []
    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        strings.append(characters(n, flags & 1) if n else "")
        take(4 * runs + more)
    return strings


def plain(b: bytes, at: int) -> str:
    """A string of one record."""
    n, flags = struct.unpack_from("<HB", b, at)
    return b[at + 3 : at + 3 + n * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def short_number(k: int) -> str:
    """A number of 30 bits: whole, or the upper part of a double; by a hundred where bit 0 is set."""
    if k & 2:
        x = float((k >> 2) - (1 << 30 if k >> 31 else 0))
    else:
        x = struct.unpack("<d", struct.pack("<Q", (k & 0xFFFFFFFC) << 32))[0]
    return number(x / 100 if k & 1 else x)


def xls_rows(content: bytes) -> list[list[str | None]]:
    """Rows of the first sheet; cells that are empty or missing are null."""
    book = stream(content, ("Workbook", "Book"))
    if struct.unpack_from("<HHH", book)[0] != BOF or struct.unpack_from("<H", book, 4)[0] != 0x600:
        raise ValueError("a workbook of an older format than Excel 97's")
    strings: list[bytes] = []
    start = last = None
    for kind, b in records(book, 0):
        if kind == FILEPASS:
            raise ValueError("the workbook is encrypted")
        if kind == BOUNDSHEET and start is None and b[5] == 0:
            start = struct.unpack_from("<I", b)[0]
        if kind == SST or (kind == CONTINUE and last == SST):
            strings.append(b)
        last = SST if kind == CONTINUE and last == SST else kind
    shared = shared_strings(strings) if strings else []
    cells: dict[tuple[int, int], str] = {}
    if start is None:
        return []
    waits = None
    for kind, b in records(book, start):
        at = struct.unpack_from("<2H", b) if len(b) >= 4 else (0, 0)
        if kind == LABELSST:
            cells[at] = shared[struct.unpack_from("<I", b, 6)[0]]
        elif kind in (LABEL, RSTRING):
            cells[at] = plain(b, 6)
        elif kind == NUMBER:
            cells[at] = number(struct.unpack_from("<d", b, 6)[0])
        elif kind == RK:
            cells[at] = short_number(struct.unpack_from("<I", b, 6)[0])
        elif kind == MULRK:
            for i in range((len(b) - 6) // 6):
                cells[at[0], at[1] + i] = short_number(struct.unpack_from("<I", b, 6 + 6 * i)[0])
        elif kind == BOOLERR:
            cells[at] = ERRORS.get(b[6], "#ERR") if b[7] else str(b[6])
        elif kind == FORMULA:
            waits = None
            if b[12:14] != b"\xff\xff":
                cells[at] = number(struct.unpack_from("<d", b, 6)[0])
            elif b[6] == 0:
                waits = at
            elif b[6] in (1, 2):
                cells[at] = str(b[8]) if b[6] == 1 else ERRORS.get(b[8], "#ERR")
        elif kind == STRING and waits is not None:
            cells[waits] = plain(b, 0)
            waits = None
    rows: list[list[str | None]] = [[] for _ in range(1 + max((r for r, _ in cells), default=-1))]
    for (r, c), text in sorted(cells.items()):
        rows[r] += [None] * (c - len(rows[r])) + [text or None]
    return rows
