"""Line-first cleaning: rules per line, then a verdict on what they leave of a document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SYMBOLS = "#*$%&|<>"
_GAPS = " \t\n\v\f\r"
_ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")
_SEPARATORS = re.compile(r"[|»›·•>]")
_BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept cookies|sign up|log in|click here|read more"
    r"|subscribe to|share (?:this|on)|enable javascript|lorem ipsum|is licensed under|copyright ©", re.I,
)
#: Words that a document must have, and percent of its words that may lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line that does not end a sentence stays if it has so many words and ends one inside.
LONG_LINE = 20
#: Percent of a document's words that its removed lines may hold.
MOST_LOST = 40


def line_fault(line: str, words: list[str]) -> str | None:
    """The first rule that a line with these words breaks."""
    n = len(words)
    marks = sum(map(line.count, "#*$%&<>"))
    if n >= 3 and 10 * len(_SEPARATORS.findall(line)) >= 2 * n:
        return "navigation"
    if n >= 3 and 10 * marks > 3 * n:
        return "symbols"
    if n >= 3 and (10 * line.count("!!") >= 3 * n or (line.isupper() and n >= 6)):
        return "shouting"
    if n >= 12 and 4 * len(set(words)) < n + 4:
        return "repetition"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    end = line.rstrip()
    if not end.endswith(_ENDS) and not (n >= LONG_LINE and any(w.endswith((".", "!", "?")) for w in words)):
        return "punctuation"
    return None


def repeated_words(words: list, width: int = 3) -> int:
    """Words inside windows of `width` that occur twice or more, the first time included."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key = ids[: n - width + 1]
    for i in range(1, width):
        key = key * len(seen) + ids[i : n - width + 1 + i]
        if i < width - 1:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(key), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, faults, cleaned)."""
    text = text if isinstance(text, str) else ""
    split = lambda s: s.encode("utf-8", "surrogatepass").split()
    words = split(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, _GAPS))
    dup, seen, faults, left, kept_lines = 0, set(), Counter(), 0, []
    for line in text.split("\n"):
        own = [w.decode("utf-8", "surrogatepass") for w in split(line)]
        if not own:
            kept_lines.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if fault := "duplicate" if again else line_fault(line, own):
            faults[fault] += 1
        else:
            left += len(own)
            kept_lines.append(line)
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    kept = not failed and 100 * (n - left) <= MOST_LOST * n
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, kept, dict(faults), "\n".join(kept_lines)


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_faults", "cleaned")


def clean(docs: DataFrame) -> DataFrame:
    """docs with the measures of their texts, a verdict and the text without its failed lines.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), line_faults (map of rule to lines), cleaned
    (string). A line that repeats an earlier one or breaks a rule is removed;
    the document is kept if it passes the base rules and its removed lines hold
    at most MOST_LOST percent of its words. A null text counts as empty and
    fails. Columns of these names are replaced; rows and other columns stay.
    """
    small_batches(docs.sparkSession)
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_faults map<string,long>, cleaned string"

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=list(_FIELDS))

    out = docs.withColumn("__j", judged("text"))
    for c in _FIELDS:
        out = out.withColumn(c, F.col(f"__j.{c}"))
    return out.drop("__j")


def op2_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents")).select("doc_id", *_FIELDS[:7])
