"""Readers: delimited exports with their header anywhere, several files as one table, spreadsheets, Parquet."""

from __future__ import annotations

import csv
import functools
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucolake.operators.export import source_id
from glucolake.sources.probe import PROBE_ROWS, Probe, clean_names, probe_file, probe_rows, separator
from glucolake.sources.xls import xls_rows

BOOKKEEPING = (".source_file", ".source_id", ".import_header_row", ".import_first_data_row")


def read_delimited(spark: SparkSession, path: str, header_row: int = 1, first_data_row: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, with the bookkeeping columns and ``_ord`` (the place of the record's first line in its file).

    Lines are read as text, in splits, and records are parsed by ``from_csv``; only the lines up to the
    header come to the driver.  Short rows are filled with nulls.  Quoted fields may hold line
    breaks (which come out as ``\\n``), quotes (doubled) and separators; a quote inside an unquoted field is itself,
    and a field with text after its closing quote stays as it stands in the file.
    """
    file = path.rstrip("/").rsplit("/", 1)[-1]
    if not re.search(r"\.(csv|txt|tsv)$", file, re.I):
        raise ValueError(f"Unsupported file type: {file}. Use csv, txt, tsv, xlsx or xls.")
    first = max(header_row + 1, first_data_row or 0)
    head = [r["value"] for r in spark.read.text(path).limit(max(first, 20)).collect()]
    if len(head) < header_row:
        raise ValueError(f"{file} has no row {header_row}")
    sep = separator(head[header_row - 1 :], file)
    names = clean_names(next(csv.reader(iter([f"{x}\n" for x in head[header_row - 1 :]]), delimiter=sep), []))
    # The ids of the first split count from 0, and the header lies in it.
    lines = spark.read.text(path).withColumn("_ord", F.monotonically_increasing_id())
    lines = records(lines.where(F.col("_ord") >= header_row - 1), sep).where(F.col("_ord") >= first - 1)
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    d = lines.where(F.trim("value") != "").select("_ord", F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}).alias("r"))
    keep = [i for i, n in enumerate(names) if columns is None or n in columns]
    return d.select(*(F.col(f"r.c{i}").alias(names[i]) for i in keep), F.lit(file).alias(".source_file"), F.lit(source_id(file)).alias(".source_id"), F.lit(header_row).alias(".import_header_row"), F.lit(first).alias(".import_first_data_row"), "_ord")


def ends_quoted(line: str, quoted: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted field, given whether it begins inside one."""
    at = 0
    while True:
        if not quoted:
            if not line.startswith('"', at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            end = line.find('"', at)
            if end < 0:
                return True
            at = end + 1
            if not line.startswith('"', at):
                break
            at += 1
        quoted = False
        at = line.find(sep, at) + 1  # what follows the closing quote is part of the field
        if not at:
            return False


def whole_lines(sep: str) -> str:
    """A pattern of lines that, begun outside quotes, end outside."""
    s = re.escape(sep)
    field = f'(?:"(?:[^"]|"")*+"(?!")[^{s}]*+|[^"{s}][^{s}]*+|)'
    return f"^{field}(?:{s}{field})*+$"


def records(lines: DataFrame, sep: str) -> DataFrame:
    """Lines (``value``, ``_ord``: the split above 33 bits and the line in it) joined to records where quoted fields go on in the next line.

    Where no line can end inside quotes, lines are records.  Else each split tells, for both
    ways it may begin, how it ends; from these two bits of all splits before it follows how a split does begin, so all splits are cut
    into records side by side.  A record over several splits is put together from a piece of each.
    """
    lines = lines.select("value", "_ord")
    if not lines.where(F.contains("value", F.lit('"')) & ~F.col("value").rlike(whole_lines(sep))).limit(1).count():
        return lines

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, [False, True]
        for batch in batches:
            for line, ord_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = ord_ >> 33
                if '"' in line:
                    ends = [ends_quoted(line, e, sep) for e in ends]
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]])], ["split", "out", "quoted"])

    starts, quoted = {}, False
    for row in sorted(lines.mapInArrow(both, "split long, out boolean, quoted boolean").collect()):  # a row for each split
        starts[row["split"]] = quoted
        quoted = row["quoted"] if quoted else row["out"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records, and pieces of records: 1 opens one, 2 goes on, 3 ends it."""
        held: list[str] = []
        place = kind = None
        quoted = False

        def row(value: list[str], ord_: list[int], piece: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(ord_, pa.int64()), pa.array(piece, pa.int32())], ["value", "_ord", "piece"])

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for line, ord_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind is None:
                    quoted = starts[ord_ >> 33]
                    kind = 2 if quoted else 0
                if not held:
                    place = ord_
                held.append(line)
                quoted = ends_quoted(line, quoted, sep) if quoted or '"' in line else False
                if not quoted:
                    for x, v in zip(out, ("\n".join(held), place, 3 if kind == 2 else 0), strict=True):
                        x.append(v)
                    held, kind = [], 0
            yield row(*out)
        if held:
            yield row(["\n".join(held)], [place], [kind or 1])

    pieces = lines.mapInArrow(cut, "value string, _ord long, piece int")
    # At most two pieces a split.
    of = F.count_if(F.col("piece") == 1).over(Window.partitionBy(F.lit(1)).orderBy("_ord"))
    broken = pieces.where("piece > 0").withColumn("of", of).groupBy("of").agg(F.min("_ord").alias("_ord"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_ord", "value"))), lambda x: x["value"])).alias("value"))
    return pieces.where("piece = 0").select("value", "_ord").unionByName(broken.select("value", "_ord"))


def row_boundaries(header_row, first_data_row=None, suggested: tuple[int, int] = (1, 2)) -> tuple[int, int]:
    """Header row and first row of data as a user gave them, put right: what isn't a row number becomes the suggested one, data begin below the header."""
    def number(x) -> int | None:
        try:
            return int(float(x))
        except (TypeError, ValueError, OverflowError):
            return None

    header = number(header_row)
    header = max(1, suggested[0]) if header is None or header < 1 else header
    first = number(suggested[1] if first_data_row is None else first_data_row)
    return header, first if first is not None and first > header else header + 1


def read_xlsx(spark: SparkSession, path: str, header_row: int = 1, first_data_row: int | None = None) -> DataFrame:
    """The first sheet of a workbook, xlsx or xls, all columns as text.  A workbook is one file of bounded size (a million rows, or 65 536) and is parsed in one task; its header comes to the driver."""
    file = path.rsplit("/", 1)[-1]
    first = max(header_row + 1, first_data_row or 0)
    rows = workbook_rows(spark, path)
    header = rows.where(F.col("_ord") == header_row).first()
    names = clean_names(header["r"]) if header else []
    d = rows.where(F.col("_ord") >= first)
    return d.select(*(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)), F.lit(file).alias(".source_file"), F.lit(source_id(file)).alias(".source_id"), F.lit(header_row).alias(".import_header_row"), F.lit(first).alias(".import_first_data_row"), "_ord")


def is_workbook(path: str) -> bool:
    return path.lower().endswith((".xlsx", ".xls"))


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """``_ord``, the number of a row in the first sheet (from 1), and ``r``, its cells."""
    read = xls_rows if path.lower().endswith(".xls") else sheet_rows

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = read(content)
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(at + 1, at + 1 + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], ["_ord", "r"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "_ord long, r array<string>")


def probe_any(spark: SparkSession, path: str) -> Probe:
    """Boundaries of a delimited file or of a workbook's first sheet."""
    if not is_workbook(path):
        return probe_file(spark, path)
    rows = workbook_rows(spark, path).where(F.col("_ord") <= PROBE_ROWS).orderBy("_ord").collect()
    return probe_rows([[x or "" for x in r["r"]] for r in rows], path.rsplit("/", 1)[-1])


def sheet_rows(content: bytes) -> list[list[str | None]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        name = min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        out: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(name)).iterfind(".//m:row", ns):
            cells: list[str | None] = []
            for c in row.findall("m:c", ns):
                at = functools.reduce(lambda n, ch: 26 * n + ord(ch) - 64, re.match("[A-Z]+", c.get("r", "A"))[0], 0) - 1
                cells += [None] * (at - len(cells))
                v = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else None if v is None else v.text
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            while len(out) < int(row.get("r", len(out) + 1)) - 1:
                out.append([])
            out.append(cells)
        return out


def compatible(frames: list[DataFrame]) -> bool:
    """Whether all have the same columns in the same order, apart from bookkeeping."""
    columns = [[c for c in f.columns if c not in BOOKKEEPING] for f in frames]
    return all(c == columns[0] for c in columns)


def read_files(spark: SparkSession, paths: list[str], header_rows: list[int] | None = None, first_data_rows: list[int] | None = None) -> DataFrame:
    """Several exports as one table; boundaries come from probing where they aren't given.  ``_ord`` counts on from file to file."""
    frames = []
    for k, path in enumerate(paths):
        if header_rows is None:
            found = probe_any(spark, path)
            header, first = found.header_row, found.first_data_row
        else:
            header, first = row_boundaries(header_rows[k], first_data_rows[k] if first_data_rows else None)
        frames.append((read_xlsx if is_workbook(path) else read_delimited)(spark, path, header, first).withColumn("_ord", F.col("_ord") + F.lit(k << 52)))
    if not compatible(frames):
        raise ValueError("Uploaded files must have the same columns in the same order.")
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


# The example files by their percentage of missing readings.
EXAMPLES = {5: "CGMExmplDat5Pct.csv", 10: "CGMExmplDat10Pct.csv"}


def read_example(spark: SparkSession, folder: str, missing_percent: int = 5) -> DataFrame:
    """An example table of the folder where such files lie, with the bookkeeping columns; ``FileNotFoundError`` where it isn't there."""
    if missing_percent not in EXAMPLES:
        raise ValueError("examples have 5 or 10 percent missing")
    path = f"{folder.rstrip('/')}/{EXAMPLES[missing_percent]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{missing_percent} percent missing example CGM data file was not found.")
    return read_delimited(spark, path)


def dimensions(df: DataFrame) -> tuple[int, int]:
    """Rows and user columns."""
    return df.count(), len([c for c in df.columns if c not in BOOKKEEPING and c != "_ord"])


def preview(df: DataFrame, n: int = 8) -> DataFrame:
    """The first rows, with the file's name in front where there are several."""
    files = df.select("`.source_file`").distinct().limit(2).count() if ".source_file" in df.columns else 1
    d = df.orderBy("_ord").limit(n)
    front = [F.col("`.source_file`").alias("Source file")] if files > 1 else []
    return d.select(*front, *(F.col(f"`{c}`") for c in df.columns if c not in BOOKKEEPING and c != "_ord"))
