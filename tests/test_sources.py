import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glucolake.sources import delimited as D
from glucolake.sources import probe as P
from glucolake.sources import standardize as S


@pytest.mark.parametrize("raw,order,want", [
    ("2026-05-05T08:15:00", "dmy", "2026-05-05T08:15:00"), ("2026-05-05T08:15:00Z", "dmy", "2026-05-05T08:15:00"), ("2026-05-05 08:15:00.250", "dmy", "2026-05-05T08:15:00"),
    ("2026-05-05T08:15:00+0000", "dmy", "2026-05-05T08:15:00"), ("2026-05-05T08:15:00+02:00", "dmy", "2026-05-05T06:15:00"), ("2026:05:05:08:15", "dmy", "2026-05-05T08:15:00"),
    ("2026:05:05:08:15:30", "dmy", "2026-05-05T08:15:30"), ("05/13/2026 02:15 PM", "mdy", "2026-05-13T14:15:00"), ("05/13/2026 02:15 PM", "dmy", "2026-05-13T14:15:00"),
    ("13-05-2026 14:15", "dmy", "2026-05-13T14:15:00"), ("01-02-2019 02:49", "dmy", "2019-02-01T02:49:00"), ("01-02-2019 02:49", "mdy", "2019-01-02T02:49:00"),
    ("2026-05-05", "dmy", "2026-05-05T00:00:00"), ("05/06/2026", "dmy", "2026-06-05T00:00:00"), ("45000.5", "dmy", "2023-03-15T12:00:00"), ("1/2/70 3:04", "dmy", "1970-02-01T03:04:00"),
    ("1/2/68 3:04", "dmy", "2068-02-01T03:04:00"), ("garbage", "dmy", None), ("", "dmy", None), (None, "dmy", None), ("12", "dmy", None),
])
def test_timestamps(spark, raw, order, want):
    got = spark.createDataFrame([(raw,)], "t string").select(F.date_format(S.parse_timestamp(F.col("t"), order), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    assert got == want


def test_fast_parser_knows_year_first_only(spark):
    df = spark.createDataFrame([("05/05/2026",), ("2026-05-05 01:02",)], "t string")
    assert [r[0] is None for r in df.select(S.parse_timestamp(F.col("t"), parser="fasttime")).collect()] == [True, False]


def test_glucose_text(spark):
    df = spark.createDataFrame([("1,000",), ("120",), ("",), ("high",), ("6",)], "g string")
    assert [r[0] for r in df.select(S.coerce_glucose(F.col("g"))).collect()] == [1000, 120, None, None, 6]
    assert df.where("g = '6'").select(S.to_mg_dl(S.coerce_glucose(F.col("g")), "mmol/L")).first()[0] == pytest.approx(108.1092)


def test_standardize(spark):
    raw = spark.createDataFrame([(1, "A", "2026-01-01 00:05", "120"), (2, "A", "2026-01-01 00:00", "1,100"), (3, "B", None, "")], "_ord long, subject string, time string, value string")
    meta = spark.createDataFrame([("A", "x ", " "), ("A", "later", " "), ("B", "", " ")], "id string, group string, empty_feature string")
    out = S.standardize(raw, {"id": "subject", "timestamp": "time", "glucose": "value"}, metadata=meta)
    assert out.columns == ["id", "id_source", "timestamp", "glucose", "units", "device", "source_file", "imputed_flag", "_ord", "group"]
    assert [r["glucose"] for r in S.sorted_table(out).collect()] == [1100, 120, None]
    assert {r["id"]: r["group"] for r in out.collect()} == {"A": "x", "B": None}
    with pytest.raises(ValueError, match="mapping"):
        S.standardize(raw, {"id": "subject", "timestamp": "time"})
    with pytest.raises(ValueError, match="not in the data"):
        S.standardize(raw, {"id": "nobody", "timestamp": "time", "glucose": "value"})
    with pytest.raises(ValueError, match="parsed"):
        S.standardize(raw.withColumn("time", F.lit("later")), {"id": "subject", "timestamp": "time", "glucose": "value"})


def test_probe_finds_header_and_first_reading():
    rows = [["Patient export", "", ""], ["Device", "Dexcom G6", ""], ["Timestamp", "Event Type", "Glucose Value (mg/dL)"], ["", "FirstName", "Ann"], ["2026-01-01 00:00:00", "EGV", "110"]]
    p = P.probe_rows(rows)
    assert (p.profile, p.header_row, p.header_status, p.first_data_row, p.reading_status) == ("Dexcom", 3, "Ready", 5, "Ready")
    assert P.probe_rows([["a", "b"], ["1", "2"]]).header_status == "Review"
    assert P.probe_rows([]).header_row == 1


def test_clean_names():
    assert P.clean_names([" id ", "", None, "id", "id"]) == ["id", "Column 2", "Column 3", "id 1", "id 2"]


def test_delimited_files(spark, tmp_path):
    one, two = tmp_path / "s1.csv", tmp_path / "s2.export.csv"
    one.write_text('Libre export\n\nDevice Timestamp,Historic Glucose mg/dL,Note\n2026-01-01 00:00,"1,00",x\n2026-01-01 00:15,101\n')
    two.write_text("Libre export\n\nDevice Timestamp,Historic Glucose mg/dL,Note\n2026-01-02 00:00,90,y\n")
    d = D.read_files(spark, [str(one), str(two)])
    got = [tuple(r) for r in d.orderBy("_ord").select("Device Timestamp", "Historic Glucose mg/dL", "Note", "`.source_id`").collect()]
    assert got == [("2026-01-01 00:00", "1,00", "x", "s1"), ("2026-01-01 00:15", "101", None, "s1"), ("2026-01-02 00:00", "90", "y", "s2.export")]
    assert D.dimensions(d) == (3, 3) and D.preview(d, 1).first()["Source file"] == "s1.csv"
    (tmp_path / "s3.csv").write_text("Time,Glucose\n2026-01-01 00:00,1\n")
    with pytest.raises(ValueError, match="same columns"):
        D.read_files(spark, [str(one), str(tmp_path / "s3.csv")])
    with pytest.raises(ValueError, match="Unsupported"):
        D.read_delimited(spark, str(tmp_path / "x.pdf"))


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Time</t></si><si><t>Glucose</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>45000.5</v></c><c r="B2"><v>99</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(buffer.getvalue())
    d = D.read_xlsx(spark, str(tmp_path / "w.xlsx"))
    assert [tuple(r) for r in d.select("Time", "Glucose").collect()] == [("45000.5", "99")]


@pytest.mark.parametrize("given,want", [
    ((1, None), (1, 2)), ((3, 7), (3, 7)), ((3, 3), (3, 4)), ((3, 1), (3, 4)), ((0, 5), (2, 5)), ((None, None), (2, 6)), (("x", "y"), (2, 3)), (("4", "9"), (4, 9)), ((-2, None), (2, 6)), ((10, None), (10, 11)),
])
def test_row_boundaries(given, want):
    assert D.row_boundaries(*given, suggested=(1, 2) if given == (1, None) else (2, 6)) == want


def test_mappings():
    columns = ["subject", "time", "value", ".source_id"]
    full = {"id": "subject", "timestamp": "time", "glucose": "value", "device": ""}
    assert S.validated_mapping(columns, full) == full | {"device": None}
    assert S.validated_mapping(columns, full, "multi_file")["id"] == ".source_id"
    assert S.validated_mapping(columns, full | {"id": float("nan")})["id"] == ".source_id"
    with pytest.raises(ValueError, match="Missing required column mapping: id, glucose"):
        S.validated_mapping(columns[:3], {"timestamp": "time", "glucose": ""})
    with pytest.raises(ValueError, match="not in the data: maker"):
        S.validated_mapping(columns, full | {"device": "maker"})
    assert S.mapped_columns(full) == ["subject", "time", "value"] and S.mapped_columns(full, "multi_file") == ["time", "value"]
    assert S.mapped_columns(full | {"glucose": "time"}) == ["subject", "time"]


def csv_rows(text, skip, width, sep=","):
    """What csv.reader gives below the header, blank lines left out, as wide as the header; empty fields are null, a field with text after its quotes stays as it stands."""
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))[skip:]
    raw = lambda x: '"end"tail' if x == "endtail" else x or None
    return [tuple(raw(x) for x in (r + [""] * width)[:width]) for r in rows if any(x.strip() for x in r)]


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of 200 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, small_splits, seed):
    """Breaks, separators and quotes inside fields, ragged rows, a header further down: as csv.reader has it."""
    rng = random.Random(seed)
    field = lambda: rng.choice(["plain", "7", "", '"quoted, field"', '"a ""word"" here"', '"two\nlines"', '"' + "long\n" * rng.randrange(1, 150) + '"', '5" pipe', 'x"y"z', '"end"tail', "é"])
    lines = [",".join(field() for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(150)]
    text = 'Export "of a device\nsecond line\na,b,c\n' + "\n".join(lines) + "\n"
    (tmp_path / "f.csv").write_text(text)
    d = D.read_delimited(spark, str(tmp_path / "f.csv"), header_row=3)
    assert spark.read.text(str(tmp_path / "f.csv")).rdd.getNumPartitions() > 5
    got = [(r["a"], r["b"], r["c"]) for r in d.orderBy("_ord").collect()]
    below = "\n".join(text.split("\n")[2:])
    assert got == csv_rows(below, 1, 3)


def test_a_quote_without_end_takes_the_rest(spark, tmp_path, small_splits):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n3,\"open\n" + "x,y\n" * 200)
    got = D.read_delimited(spark, str(tmp_path / "f.csv")).orderBy("_ord").collect()
    assert len(got) == 2 and got[0]["b"] == "2" and got[1]["b"].startswith("open\nx,y") and got[1]["b"].count("x,y") == 200


def test_ends_quoted():
    for line, out, quoted in [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a"",', True, False), ('","', False, True), ('x"y,"z', True, True), ('"a"b",c', False, False), ("", False, True)]:
        assert (D.ends_quoted(line, False, ","), D.ends_quoted(line, True, ",")) == (out, quoted), line


def test_parse_summary_of_all_rows(spark):
    """A sample of the first rows can say that all is well where the whole table isn't."""
    df = spark.range(40).select(F.col("id").alias("_ord"), F.when(F.col("id") < 30, "2026-01-01 00:00:00").otherwise("junk").alias("t"))
    assert S.parse_summary(df, "t", sample=20).first()["failed"] == 0
    whole = S.parse_summary(df, "t", sample=None).first()
    assert (whole["sampled_rows"], whole["failed"], whole["parsed"]) == (40, 10, 30)


def test_examples(spark, tmp_path):
    (tmp_path / "CGMExmplDat10Pct.csv").write_text("id,timestamp,glucose\na,2024-01-01 00:00:00,101\na,2024-01-01 00:05:00,\n")
    d = D.read_example(spark, str(tmp_path), 10)
    assert [tuple(r) for r in d.select("id", "glucose", "`.source_file`").orderBy("_ord").collect()] == [("a", "101", "CGMExmplDat10Pct.csv"), ("a", None, "CGMExmplDat10Pct.csv")]
    with pytest.raises(FileNotFoundError, match="5 percent missing"):
        D.read_example(spark, str(tmp_path))
    with pytest.raises(ValueError, match="5 or 10"):
        D.read_example(spark, str(tmp_path), 7)
