"""Older workbooks, written here record by record, against the rows they were made from."""

import io
import struct
import zipfile

import pytest

from glucolake.sources import delimited as D
from glucolake.sources import xls as X


def record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<2H", kind, len(body)) + body


def cell(kind: int, r: int, c: int, body: bytes) -> bytes:
    return record(kind, struct.pack("<3H", r, c, 0) + body)


def book(cells: bytes, strings: list[bytes], version: int = 0x600) -> bytes:
    """Globals with a table of strings (a record and its continuations), then one sheet."""
    sst = record(0xFC, strings[0]) + b"".join(record(0x3C, s) for s in strings[1:])
    bof = lambda kind: record(0x809, struct.pack("<4H", version, kind, 0, 0) + bytes(8))
    sheet = lambda at: record(0x85, struct.pack("<I2BBB", at, 0, 0, 2, 0) + b"S1")
    start = len(bof(5) + sheet(0) + sst + record(0x0A))
    chart = bof(0x20) + cell(0x203, 0, 0, struct.pack("<d", -1.0)) + record(0x0A)
    return bof(5) + sheet(start) + sst + record(0x0A) + bof(0x10) + chart + cells + record(0x0A)


def compound(data: bytes) -> bytes:
    """A compound file of sectors of 512 bytes: allocation table, directory, mini table, the stream."""
    small = len(data) < 4096
    unit = 64 if small else 512
    n = -(-len(data) // unit)
    body = data.ljust(n * unit, b"\0")
    sectors = -(-len(body) // 512)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    fat = [0xFFFFFFFD, end, end if small else free, *range(4, 3 + sectors), end]
    assert len(fat) <= 128
    entry = lambda name, kind, start, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H2B", 2 * len(name) + 2, kind, 1) + struct.pack("<3I", free, free, 1) + bytes(36) + struct.pack("<2IQ", 0, start, size)[4:][:12]
    root = entry("Root Entry", 5, 3 if small else end, len(body) if small else 0)
    workbook = entry("Workbook", 2, 0 if small else 3, len(data))
    mini = [*range(1, n), end] if small else []
    head = X.SIGNATURE + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<8I", 0, 1, 1, 0, 4096, 2 if small else end, int(small), end)
    head += struct.pack("<I", 0) + struct.pack("<109I", 0, *[free] * 108)
    words = lambda x: struct.pack(f"<{len(x)}I", *x).ljust(512, b"\xff")
    return head + words(fat) + (root + workbook).ljust(512, b"\0") + words(mini) + body.ljust(sectors * 512, b"\0")


def narrow(text: str) -> bytes:
    return struct.pack("<HB", len(text), 0) + text.encode("latin-1")


STRINGS = [
    struct.pack("<2I", 5, 5) + narrow("Time") + struct.pack("<HB", 7, 0) + b"Glu",
    b"\x01" + "cose".encode("utf-16-le") + struct.pack("<HBH", 2, 8 | 1, 1) + "éß".encode("utf-16-le") + bytes(4) + struct.pack("<HBI", 1, 4, 3) + b"x\1\2\3",
    narrow(""),
]
SHARED = ["Time", "Glucose", "éß", "x", ""]


def cells() -> tuple[bytes, list[list[str | None]]]:
    text = lambda r, c, k: cell(0xFD, r, c, struct.pack("<I", k))
    out = [text(0, 0, 0), text(0, 1, 1), text(0, 2, 2), cell(0x204, 0, 3, narrow("Note"))]
    out += [cell(0x203, 1, 0, struct.pack("<d", 45000.5)), cell(0x27E, 1, 1, struct.pack("<I", (99 << 2) | 2)), cell(0x27E, 1, 2, struct.pack("<I", (1234 << 2) | 3)), text(1, 3, 4)]
    out += [record(0xBD, struct.pack("<2H", 3, 1) + struct.pack("<HIHI", 0, (-5 & 0x3FFFFFFF) << 2 | 2, 0, struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) + struct.pack("<H", 2))]
    formula = lambda r, c, result: cell(0x06, r, c, result + bytes(8))
    out += [formula(4, 0, struct.pack("<d", 7.25)), formula(4, 1, b"\0\0\0\0\0\0\xff\xff"), record(0x207, struct.pack("<HB", 2, 1) + "Δt".encode("utf-16-le"))]
    out += [formula(4, 2, b"\1\0\1\0\0\0\xff\xff"), formula(4, 3, b"\2\0\x07\0\0\0\xff\xff"), cell(0x205, 5, 0, b"\1\0"), cell(0x205, 5, 1, b"\x2a\1"), formula(5, 2, b"\3\0\0\0\0\0\xff\xff")]
    rows = [["Time", "Glucose", "éß", "Note"], ["45000.5", "99", "12.34", None], [], [None, "-5", "1.5"], ["7.25", "Δt", "1", "#DIV/0!"], ["1", "#N/A"]]
    return b"".join(out), rows


@pytest.mark.parametrize("more", [0, 5000])
def test_rows_of_a_workbook(more):
    """A small stream (in the mini stream) and a large one; strings cut at a record's end; every kind of cell; a chart in the sheet."""
    content, rows = cells()
    assert X.shared_strings(STRINGS) == SHARED
    assert X.xls_rows(compound(book(content, STRINGS) + bytes(more))) == rows


def test_empty_sheet_and_refusals():
    assert X.xls_rows(compound(book(b"", STRINGS))) == []
    with pytest.raises(ValueError, match="older format"):
        X.xls_rows(compound(book(b"", STRINGS, 0x500)))
    with pytest.raises(ValueError, match="compound file"):
        X.xls_rows(b"PK\3\4")
    locked = book(b"", STRINGS)
    locked = locked[:20] + record(0x2F, b"\0\0") + locked[20:]
    with pytest.raises(ValueError, match="encrypted"):
        X.xls_rows(compound(locked))


def test_read_as_the_xlsx_one(spark, tmp_path):
    """The same sheet in both formats gives the same table, by given and by probed boundaries."""
    readings = [(f"2024-01-01 {h:02d}:{m:02d}:00", str(90 + h + m)) for h in range(8) for m in range(0, 60, 5)]
    rows = [("Timestamp", "Glucose Value (mg/dL)"), *readings]
    xml = "".join(f'<row r="{i}">' + "".join(f'<c r="{"AB"[k]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{xml}</sheetData></worksheet>')
    (tmp_path / "new.xlsx").write_bytes(buffer.getvalue())
    old = b"".join(cell(0x204, i, k, narrow(v)) for i, r in enumerate(rows) for k, v in enumerate(r))
    (tmp_path / "old.xls").write_bytes(compound(book(old, [struct.pack("<2I", 0, 0)])))
    for given in (None, [1]):
        old_, new = (D.read_files(spark, [str(tmp_path / f)], given).orderBy("_ord").select("Timestamp", "Glucose Value (mg/dL)", "`.import_header_row`") for f in ("old.xls", "new.xlsx"))
        assert [tuple(r) for r in old_.collect()] == [tuple(r) for r in new.collect()] == [(*r, 1) for r in readings]
