"""Quality rules: how much of a text lies in repeated n-grams and lines (numpy, one Arrow batch at a time)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, small_arrow_batches, table

#: The largest share of a text's characters that its most frequent n-gram may hold, by n.
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}
#: The largest share of a text's characters inside n-grams that repeat an earlier one, by n.
DUP_NGRAM = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Fixed value: the largest share of a text's characters in lines that repeat an earlier line.
DUP_LINE_CHARS = 0.20
#: Fewest words of a kept text.
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, "
    "dup_line_char_share double, top_ngram_excess double, dup_ngram_excess double, base_failed boolean, kept boolean"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def covered(repeated: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in an n-word window whose start is marked."""
    steps = np.zeros(size + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def repeats(keys: np.ndarray, first_too: bool = False) -> tuple[np.ndarray, int, int]:
    """Marks of the values that equal an earlier one (or any other one); the highest count and where that value first stands."""
    order = np.argsort(keys, kind="stable")
    run = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    starts = np.flatnonzero(run)
    counts = np.diff(np.append(starts, len(keys)))
    marks = np.empty(len(keys), bool)
    marks[order] = np.repeat(counts > 1, counts) if first_too else ~run  # the sort is stable: a run begins with its first
    top = counts.max()
    return marks, int(top), int(order[starts[counts == top]].min())


def measure(text: str | None) -> tuple:
    """The values of SCHEMA for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly the six ASCII white space characters
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    if not n:
        return 0, 0, symbols, 0, 0, 0.0, 0.0, 0.0, 0.0, True, False
    if len(raw) == len(text):
        lengths = np.fromiter(map(len, words), np.int64, n)
    else:
        lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
    chars = int(lengths.sum())
    line_chars = 0
    if dup_lines:
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                line_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in x.split())
            seen.add(x)
    distinct = dict.fromkeys(words)
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    repeat_words = 0
    if n >= 3:  # exact: pairs get numbers first, then pairs with the third word
        pair = np.unique(ids[:-2] * len(distinct) + ids[1:-1], return_inverse=True)[1]
        repeat_words = int(covered(repeats(pair * np.int64(len(distinct)) + ids[2:], first_too=True)[0], 3, n).sum())
    rolled = codes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes = rolled = codes ^ (codes >> np.uint64(29))
    sums = np.concatenate(([0], np.cumsum(lengths)))
    top_excess = dup_excess = 0.0
    for size in range(2, max(DUP_NGRAM) + 1):
        if n < size:
            break
        rolled = rolled[:-1] * BASE + codes[size - 1 :]  # hash of size words from that of size - 1
        marks, top, at = repeats(rolled)
        if size in TOP_NGRAM and top > 1:
            top_excess = max(top_excess, top * int(sums[at + size] - sums[at]) / chars / TOP_NGRAM[size])
        if size in DUP_NGRAM and marks.any():
            dup_excess = max(dup_excess, int(lengths[covered(marks, size, n)].sum()) / chars / DUP_NGRAM[size])
        if not marks.any():  # then no longer n-gram repeats either
            break
    line_share, char_share = dup_lines / len(lines), line_chars / chars
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    kept = not failed and top_excess <= 1 and dup_excess <= 1 and char_share <= DUP_LINE_CHARS
    return n, chars, symbols, dup_lines, repeat_words, line_share, char_share, top_excess, dup_excess, failed, kept


def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(x) for x in texts], columns=COLUMNS)


def repetition_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of SCHEMA to every row of docs, from its whole text.

    Nulls and texts without words: all counts 0, base_failed, not kept. Repeated rows: each has its own result. Empty
    table: empty result. Columns of docs with names of SCHEMA are replaced (names compare without case); the text
    column must not be one of them. `*_excess` is the measured share over its limit, so above 1 fails.
    """
    small_arrow_batches(docs.sparkSession)
    out = drop_clashes(docs, [*COLUMNS, "_m"], keep=(text,)).withColumn("_m", F.pandas_udf(_measures, SCHEMA)(F.col(f"`{text}`")))
    return out.select("*", *[F.col(f"_m.{c}").alias(c) for c in COLUMNS]).drop("_m")


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition_rules(docs).drop("text")
