"""What a device's export looks like: its header row, first reading, make.  Works on the first 50 lines, on the driver."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

PROBE_ROWS, PREVIEW_ROWS = 50, 8
HEADER_READY, HEADER_LEAST, READING_LEAST = 8, 6, 12

# Patterns of makes, headers and readings.
PROFILES = {
    "Dexcom": ("dexcom", r"\bg6\b", r"\bg7\b", "clarity"),
    "Abbott/Libre": ("abbott", "libre", "freestyle"),
    "Medtronic": ("medtronic", "carelink", "guardian", "minimed"),
}
HEADER_WORDS = (
    "timestamp", "time stamp", r"\btime\b", r"\bdate\b", "glucose", "sensor glucose", "glucose value", "historic.*glucose", "scan.*glucose", "sg value",
    "mg/dl", "mmol", "patient", "subject", "usubjid", "identifier", "event type", "device",
)
TIME_HEADERS = ("timestamp", "time stamp", r"\btime\b", r"\bdate\b", "device timestamp", "display time")
GLUCOSE_HEADERS = ("glucose", "glucose value", "sensor glucose", "historic.*glucose", "scan.*glucose", "interstitial.*glucose", r"\bsg\b", "sg value", "mg/dl", "mmol")
READING_WORDS = (r"\begv\b", "sensor", "historic", "scan", "reading", "glucose")
TYPE_HEADERS = ("event type", "type", "record type")
NUMBER = re.compile(r"[-+]?\d+(\.\d+)?$")
TIME = re.compile(r"\d{4}[-/:]\d{1,2}[-/:]\d{1,2}([T :]\d{1,2}:\d{2}.*)?$|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}( \d{1,2}:\d{2}.*)?$")


def clean(value: str | None) -> str:
    return re.sub(r"\s+", " ", (value or "").strip().lower())


def says(patterns: tuple[str, ...], text: str) -> bool:
    """Whether one of the patterns is in a text that has been cleaned."""
    return any(re.search(p, text) for p in patterns)


def number_like(value: str) -> bool:
    return bool(NUMBER.match(clean(value).replace(",", "")))


def time_like(value: str) -> bool:
    return bool(TIME.match(value.strip()))


def header_score(row: list[str]) -> float:
    """Filled cells, five for each kind of header word, half for each label, less three quarters for each number."""
    cells = [c for c in map(clean, row) if c]
    numbers = sum(bool(NUMBER.match(c)) for c in cells)
    words = sum(any(re.search(w, c) for c in cells) for w in HEADER_WORDS)
    return len(cells) + 5 * words + 0.5 * (len(cells) - numbers) - 0.75 * numbers if cells else 0.0


def reading_score(row: list[str], headers: list[str]) -> float:
    """Evidence that a row is a reading: a time and a number where the headers say so (or anywhere), words of sensor records, numbers."""
    if not any(c.strip() for c in row):
        return 0.0
    at = lambda patterns: [row[i] for i, h in enumerate(headers) if i < len(row) and says(patterns, clean(h))]
    named = lambda patterns: any(says(patterns, clean(h)) for h in headers)
    score = 8 * any(map(time_like, at(TIME_HEADERS))) if named(TIME_HEADERS) else 4 * any(map(time_like, row))
    score += 8 * any(map(number_like, at(GLUCOSE_HEADERS))) if named(GLUCOSE_HEADERS) else 3 * any(map(number_like, row))
    score += 3 * any(says(READING_WORDS, clean(c)) for c in row)
    score += 3 * any(says(READING_WORDS[:-1], clean(c)) for c in at(TYPE_HEADERS))
    return score + min(3, sum(number_like(c) for c in row if c.strip()))


@dataclass
class Probe:
    file: str
    profile: str
    header_row: int
    header_score: float
    header_status: str
    first_data_row: int
    reading_score: float
    reading_status: str
    preview: list[list[str]] = field(default_factory=list)


def probe_rows(rows: list[list[str]], file: str = "") -> Probe:
    """Rows are counted from 1; the first row of the highest score wins."""
    text = " ".join(c for row in rows for c in map(clean, row) if c)
    scores = [header_score(r) for r in rows] or [0.0]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    profile = next((name for name, words in PROFILES.items() if says(words, text)), "Generic CGM" if scores[best] >= HEADER_READY else "Unknown CGM")
    header = best + 1 if scores[best] >= HEADER_LEAST else 1
    after = [(reading_score(r, rows[header - 1]), -i) for i, r in enumerate(rows[header:], header + 1)] if rows else []
    top, place = max(after, default=(0.0, -(header + 1)))
    ready = top >= READING_LEAST
    return Probe(file, profile, header, scores[best], "Ready" if scores[best] >= HEADER_READY else "Review", -place if ready else header + 1, top, "Ready" if ready else "Review", rows[:PREVIEW_ROWS])


def separator(lines: list[str], filename: str = "") -> str:
    if filename.lower().endswith(".csv"):
        return ","
    try:
        return csv.Sniffer().sniff("\n".join(lines[:20]), ",;\t|").delimiter
    except csv.Error:
        return ","


def first_lines(spark: SparkSession, path: str, n: int = PROBE_ROWS) -> list[str]:
    """The first lines of a text file, read by Spark, so any file system will do."""
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def probe_file(spark: SparkSession, path: str) -> Probe:
    lines = first_lines(spark, path)
    sep = separator(lines, path)
    return probe_rows([next(csv.reader([x], delimiter=sep), []) for x in lines], path.rsplit("/", 1)[-1])


def clean_names(names: list[str | None]) -> list[str]:
    """Column names: trimmed, blank ones ``Column k``, repeated ones numbered."""
    out: list[str] = []
    for i, raw in enumerate(names, 1):
        base = (raw or "").strip() or f"Column {i}"
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base} {k}"
        out.append(name)
    return out
