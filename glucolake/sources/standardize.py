"""From raw text columns to the standardized table: timestamps, glucose, units, subject metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import MMOL_NAMES, MMOL_TO_MG

# Timestamp formats, in the order in which they are tried.
YEAR_FIRST = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy:MM:dd:HH:mm:ss", "yyyy:MM:dd:HH:mm", "yyyy-MM-dd", "yyyy/MM/dd",
)
CLOCKS = ("h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm")
DATES = {"dmy": ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy"), "mdy": ("M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy")}
AMBIGUOUS = r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})(\D.*)?$"
EXCEL_SERIAL = r"^\d+(\.\d+)?$"


def shape_of(form: str) -> str:
    """The pattern of texts that a year-first format can fit; fractions may be shorter than the format's."""
    digits = {"yyyy": r"\d{4}", "SSSSSS": r"\d{1,6}", "SSS": r"\d{1,3}", "'T'": "T", ".": r"\."}
    return "^" + re.sub(r"yyyy|S+|'T'|\.|MM|dd|HH|mm|ss", lambda m: digits.get(m[0], r"\d{2}"), form) + "$"


def date_order(name: str | None) -> str:
    return "mdy" if (name or "").strip().lower() in ("mdy", "month_first", "month-day-year") else "dmy"


def parse_timestamp(raw: Column, order: str = "dmy", parser: str = "compatibility") -> Column:
    """The first format that fits: year first, then a spreadsheet's day number, then day and month in the preferred order, then in the other.

    ``fasttime`` knows year-first formats and day numbers only.  Offsets are honoured.
    """
    text = F.trim(raw)
    # A format is only tried on texts of its shape: two-digit years would else eat four-digit ones, and a try that fails is slow.
    has = lambda pattern: text.rlike(pattern)
    offset = F.when(has(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, " (?=\\d\\d:)", "T"), "([+-]\\d\\d):?(\\d\\d)$", "$1:$2")))
    number = text.try_cast("double")
    serial = F.when(has(EXCEL_SERIAL) & (number > 20000) & (number < 80000), F.timestamp_micros(F.round((number - 25569) * 86_400_000_000).cast("long")))
    found = [offset, *(F.when(has(shape_of(f)), F.try_to_timestamp(text, F.lit(f))) for f in YEAR_FIRST), serial]
    if parser != "fasttime":
        upper = F.upper(text)
        orders = ("mdy", "dmy") if date_order(order) == "mdy" else ("dmy", "mdy")
        for o in orders:
            for d in DATES[o]:
                sep, year = d[1], r"\d{4}" if d.endswith("yyyy") else r"\d{2}"
                at = F.try_to_timestamp
                for clock in CLOCKS:
                    shape = rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}{year} \d{{1,2}}:\d{{2}}" + (r":\d{2}" if "ss" in clock else "") + (r" [AP]M$" if clock.endswith("a") else "$")
                    found.append(century(F.when(upper.rlike(shape), at(upper, F.lit(f"{d} {clock}"))), year))
        for o in orders:
            for d in DATES[o]:
                sep, year = d[1], r"\d{4}" if d.endswith("yyyy") else r"\d{2}"
                found.append(century(F.when(text.rlike(rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}{year}$"), F.try_to_timestamp(text, F.lit(d))), year))
    return F.coalesce(*found)


def century(ts: Column, year: str) -> Column:
    """Two-digit years from 69 are of the last century."""
    return ts if year != r"\d{2}" else F.when(F.year(ts) >= 2069, ts - F.expr("INTERVAL '100' YEAR")).otherwise(ts)


def is_ambiguous(raw: Column) -> Column:
    """Day and month could be swapped: both up to 12, and different."""
    a, b = (F.regexp_extract(raw, AMBIGUOUS, k).try_cast("int") for k in (1, 2))
    return F.coalesce(raw.rlike(AMBIGUOUS) & (a <= 12) & (b <= 12) & (a != b), F.lit(False))


def is_date_only(raw: Column) -> Column:
    return F.coalesce(F.trim(raw).rlike(r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/](\d{4}|\d{2}))$"), F.lit(False))


def coerce_glucose(raw: Column) -> Column:
    """A number; commas between thousands go, what isn't one is null."""
    return F.regexp_replace(F.trim(raw), ",", "").try_cast("double")


def to_mg_dl(value: Column, units: str = "mg/dL") -> Column:
    return value * MMOL_TO_MG if units.strip().lower() in MMOL_NAMES else value


def parse_summary(df: DataFrame, column: str, order: str = "dmy", parser: str = "compatibility", sample: int | None = 5000) -> DataFrame:
    """One row: how timestamps parse, over the first ``sample`` rows by ``_ord``, or over all rows where it is None."""
    rows = df.agg(F.count("*").alias("rows"))
    s = (df if sample is None else df.orderBy("_ord").limit(sample)).select(F.col(column).alias("raw"))
    s = s.withColumn("ts", parse_timestamp(F.col("raw"), order, parser)).withColumn("full", F.coalesce(F.trim("raw") != "", F.lit(False)))
    return s.agg(
        F.count("*").alias("sampled_rows"), F.count_if("full").alias("non_missing"), F.count("ts").alias("parsed"), F.count_if(F.col("full") & F.col("ts").isNull()).alias("failed"),
        F.count_if(is_ambiguous(F.col("raw"))).alias("ambiguous"), F.count_if(is_date_only(F.col("raw"))).alias("date_only"), F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"),
    ).crossJoin(F.broadcast(rows))  # fmt: skip  # one row each


def glucose_summary(df: DataFrame, column: str, units: str = "mg/dL", low: float = 40, high: float = 400) -> DataFrame:
    """One row: how glucose parses, and whether the units look wrong."""
    d = df.select(F.col(column).alias("raw"), coerce_glucose(F.col(column)).alias("g")).withColumn("mg", to_mg_dl(F.col("g"), units))
    mmol = units.strip().lower() in MMOL_NAMES
    full = F.coalesce(F.trim("raw") != "", F.lit(False))
    median = F.percentile("g", 0.5)
    return d.agg(
        F.count("*").alias("rows"), F.count_if(full).alias("non_missing"), F.count("g").alias("numeric"), F.count_if(~full).alias("missing"), F.count_if(full & F.col("g").isNull()).alias("non_numeric"),
        F.min("mg").alias("min_glucose"), F.max("mg").alias("max_glucose"), F.count_if((F.col("mg") < low) | (F.col("mg") > high)).alias("implausible"),
        F.coalesce(median > 40 if mmol else median < 25, F.lit(False)).alias("suspicious_units"),
    )


def check_parsed(df: DataFrame, raw: str, parsed: str = "timestamp") -> None:
    """Raise if a filled timestamp didn't parse, with three examples."""
    bad = df.where((F.trim(raw) != "") & F.col(parsed).isNull()).select(raw).distinct().limit(3).collect()
    if bad:
        raise ValueError("Timestamps could not be parsed, e.g. " + ", ".join(repr(r[0]) for r in bad))


def clean_metadata(meta: DataFrame) -> DataFrame:
    """One row per subject: text trimmed, blanks null, columns without any value dropped."""
    text = meta.select(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in meta.columns)).where("id is not null")
    seen = text.agg(*(F.count(c).alias(c) for c in text.columns)).first()
    keep = [c for c in text.columns if c == "id" or seen[c]]
    return text.select(*keep).groupBy("id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in keep if c != "id")) if len(keep) > 1 else text.select("id").distinct()


def metadata_from(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Metadata columns of the readings themselves: a subject's value where it is the only one."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return df.groupBy(F.col(id_column).cast("string").alias("id")).agg(*(F.when(F.count_distinct(text(c)) == 1, F.max(text(c))).alias(c) for c in columns))


REQUIRED, OPTIONAL = ("id", "timestamp", "glucose"), ("device",)


def validated_mapping(columns: list[str], mapping: dict[str, str | None], upload_mode: str = "single_file") -> dict[str, str | None]:
    """``mapping`` with blank entries as None; of several files, or where none is mapped, the id is the file's (``.source_id``).

    Raises ``ValueError`` for a required column that isn't mapped and for columns that ``columns`` doesn't have.
    """
    clean = {k: v if isinstance(v, str) and v else None for k, v in mapping.items()}
    if upload_mode == "multi_file" or not clean.get("id") and ".source_id" in columns:
        clean["id"] = ".source_id"
    if missing := [k for k in REQUIRED if not clean.get(k)]:
        raise ValueError(f"Missing required column mapping: {', '.join(missing)}")
    if unknown := [v for k in (*REQUIRED, *OPTIONAL) if (v := clean.get(k)) and v not in columns]:
        raise ValueError(f"Mapped columns are not in the data: {', '.join(unknown)}")
    return clean


def mapped_columns(mapping: dict[str, str | None], upload_mode: str = "single_file") -> list[str]:
    """The columns of a file that a mapping needs, each once: what a scan has to read."""
    found = [mapping.get(k) for k in (*REQUIRED, *OPTIONAL) if not (k == "id" and upload_mode == "multi_file")]
    return list(dict.fromkeys(c for c in found if c and not (upload_mode == "multi_file" and c == ".source_id")))


def standardize(
    df: DataFrame, mapping: dict[str, str | None], units: str = "mg/dL", metadata: DataFrame | None = None, order: str = "dmy", parser: str = "compatibility", check: bool = True, upload_mode: str = "single_file"
) -> DataFrame:
    """The standardized table of a raw one; ``mapping`` names its ``timestamp`` and ``glucose`` columns, and ``id`` and ``device`` where it has them."""
    mapping = validated_mapping(df.columns, mapping, upload_mode)
    mapped = None if mapping["id"] == ".source_id" else mapping["id"]
    q = lambda c: F.col(f"`{c}`")
    kind = dict(df.dtypes)[mapping["timestamp"]]
    ts = q(mapping["timestamp"])
    ts = ts.cast("timestamp") if kind.startswith(("timestamp", "date")) else parse_timestamp(ts.cast("string"), order, parser)
    out = df.select(
        F.nullif(F.trim((q(mapped) if mapped else q(".source_id")).cast("string")), F.lit("")).alias("id"), F.lit("mapped_column" if mapped else "filename").alias("id_source"), ts.alias("timestamp"),
        to_mg_dl(coerce_glucose(q(mapping["glucose"]).cast("string")), units).alias("glucose"), F.lit("mg/dL").alias("units"),
        (F.nullif(F.trim(q(mapping["device"]).cast("string")), F.lit("")) if mapping.get("device") else F.lit(None).cast("string")).alias("device"),
        (q(".source_file") if ".source_file" in df.columns else F.lit(None).cast("string")).alias("source_file"), F.lit(False).alias("imputed_flag"), "_ord", q(mapping["timestamp"]).cast("string").alias("__raw"),
    )
    if check:
        check_parsed(out, "__raw")
    out = out.drop("__raw")
    if metadata is not None:
        m = clean_metadata(metadata).withColumnRenamed("id", "__mid")
        out = out.join(m, F.col("id") == F.col("__mid"), "left").drop("__mid")  # Spark broadcasts subject tables that are small
    return out


def sorted_table(df: DataFrame) -> DataFrame:
    """By subject and time, rows without a timestamp last."""
    return df.orderBy("id", F.col("timestamp").asc_nulls_last(), "_ord")


def first_per_subject(df: DataFrame) -> DataFrame:
    """The first reading of each subject."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("timestamp").asc_nulls_last(), "_ord"))).where("__n = 1").drop("__n")
