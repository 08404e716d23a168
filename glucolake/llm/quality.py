"""Quality rules whose cutoffs carry a risk guarantee.

Base measures of every whole text are taken in one pass.  Each learned rule rejects a
document when a ratio exceeds a cutoff.  Cutoffs are chosen on labelled documents, for each
stratum (``lang``): from the loosest to the tightest, a cutoff is accepted while the exact
(Clopper-Pearson) upper bound of its false rejection rate, on documents labelled good, stays
at most ``ALPHA / rules``; the first failure ends the sequence, so a sequence spends its
error level once, and the level ``DELTA`` is divided by strata times rules (Bonferroni).
With probability 1 - DELTA the learned rules take no more than ALPHA of any stratum's good
documents; what the base rule (too few words, too many repeated ones) takes comes on top.  Strata
are tested while they have the good labels that even the loosest cutoff needs
(``least_stratum``, a number fixed before any ratio is looked at); a stratum with fewer, or
without labels, has no guarantee to give and no learned rule rejects its documents.

Null texts have no words; a null stratum is a stratum of its own.  A document labelled more
than once counts as good if any of its labels says so; null labels are ignored.  Without
labels no learned rule rejects.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.llm.shared import batched, steps, texts_of, written

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Fixed sequence of cutoffs, loosest first; the ratios are at most 1 except the symbol ratio, which is cut at 1.
GRID = [1.0, *(x / 100 for x in (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 18, 16, 14, 12, 10, 8, 6, 5))]
RULES = ("symbol_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def least_stratum(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good labels with which a stratum, one of so many, can certify a cutoff that rejects none of them: (1 - alpha / rules) ^ n <= delta / (strata * rules)."""
    return math.ceil(math.log(delta / (strata * len(RULES))) / math.log1p(-alpha / len(RULES)))


#: Good labels below which no stratum has cutoffs, were it the only one.
MIN_STRATUM = least_stratum(1)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    base = len(number)
    if base == n:
        return 0
    if base < 2_000_000:
        key = (w[:-2] * base + w[1:-1]) * base + w[2:]
    else:
        pair = np.unique(w[:-2] * base + w[1:-1], return_inverse=True)[1].astype(np.int64)
        key = pair * base + w[2:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return 0
    again = order[np.r_[same, False] | np.r_[False, same]]
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[again + i] = True
    return int(covered.sum())


def measures_of(text: bytes) -> tuple:
    """Base measures, then lines with a word, letters in capitals (A-Z) and all letters A-Z, a-z."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    bare = text.translate(None, b" \t\n\v\f\r")
    letters = text.translate(None, NOT_LETTERS)
    capitals = len(letters.translate(None, SMALL))
    return (len(words), points - (len(text) - len(bare)), sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), capitals, len(letters))


SMALL = bytes(range(97, 123))
NOT_LETTERS = bytes(b for b in range(256) if b not in set(SMALL) | set(range(65, 91)))


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Base measures and rule ratios of every text, beside the id and the columns of ``also``."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    keep = [id_column, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                rows = [measures_of(t) for t in texts_of(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], [*keep, *names])

    names = [*(x.split()[0] for x in BASE.split(", ")), "n_lines", "n_capitals", "n_letters"]
    out = batched(docs.select(text_column, *keep)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in names)]))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    return out.withColumns({
        "symbol_ratio": ratio("n_symbols", "word_chars"), "shout_ratio": ratio("n_capitals", "n_letters"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def certified(rejected: int, good: int, limit: float, level: float) -> bool:
    """Whether the exact upper bound, at ``level``, of a rate seen as ``rejected`` of ``good`` is at most ``limit``: P(Bin(good, limit) <= rejected) <= level."""
    if not good or rejected >= limit * good:
        return False
    logs = [math.lgamma(good + 1) - math.lgamma(i + 1) - math.lgamma(good - i + 1) + i * math.log(limit) + (good - i) * math.log1p(-limit) for i in range(rejected + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(level)


def cutoffs(table: DataFrame, labels: DataFrame, stratum: str = "lang", id_column: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Cutoff of each rule by stratum; strata that aren't here have none (the key ``""`` stands for them).

    What comes to the driver is a count for each stratum, rule and step of the grid.
    """
    good = labels.where("quality is not null").groupBy(id_column).agg(F.max("quality").alias("quality")).where("quality = 1")
    rows = table.join(good.select(id_column), id_column, "left_semi")
    tight = lambda c: sum((F.col(c) > g).cast("int") for g in GRID)  # noqa: E731  how many cutoffs reject it
    counts = (
        rows.select(F.col(stratum).alias("s"), F.posexplode(F.array(*(tight(c) for c in RULES))).alias("rule", "n"))
        .groupBy("s", "rule", "n").count().collect()
    )
    size: dict[str | None, int] = {}
    for r in counts:
        if r["rule"] == 0:
            size[r["s"]] = size.get(r["s"], 0) + r["count"]
    # As many of the largest strata as can all certify a cutoff at the level that so many leave to each.
    by_size = sorted(size.values(), reverse=True)
    strata = max((k for k, n in enumerate(by_size, 1) if n >= least_stratum(k, alpha, delta)), default=0)
    tested = {s for s, n in size.items() if strata and n >= least_stratum(strata, alpha, delta)}
    total: dict[tuple, int] = {}
    seen: dict[tuple, np.ndarray] = {}
    for r in counts:
        if r["s"] not in tested:
            continue
        key = (r["s"], r["rule"])
        total[key] = total.get(key, 0) + r["count"]
        over = seen.setdefault(key, np.zeros(len(GRID), np.int64))
        over[len(GRID) - r["n"] :] += r["count"]  # GRID falls, so the last n cutoffs reject it
    out: dict[str | None, dict[str, float]] = {s: {} for s in {*tested, ""}}
    level = delta / (max(1, strata) * len(RULES))
    for (s, rule), over in seen.items():
        for cut, rejected in zip(GRID, over.tolist(), strict=True):
            if not certified(rejected, total[s, rule], alpha / len(RULES), level):
                break
            out[s][RULES[rule]] = cut
    return out


def judged(table: DataFrame, cuts: dict[str | None, dict[str, float]], stratum: str = "lang") -> DataFrame:
    """``table`` with ``rejected_by`` (rules that reject the row) and ``kept``."""
    def cut(rule: str):
        own = F.lit(1.0)  # no ratio is above
        for s, by in cuts.items():
            if s != "":
                own = F.when(F.col(stratum).eqNullSafe(F.lit(s)), F.lit(by.get(rule, 1.0))).otherwise(own)
        return own

    table = table.withColumn("rejected_by", F.filter(F.array(*(F.when(F.col(r) > cut(r), F.lit(r)) for r in RULES)), lambda x: x.isNotNull()))
    return table.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str = "lang", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, stratum, base measures, ``base_failed``, ``rejected_by`` and ``kept``, beside the columns of ``also``."""
    table = written(measures(docs, id_column, text_column, (stratum, *also)), "measures")
    return judged(table, cutoffs(table, labels, stratum, id_column), stratum)
