"""Line-first cleaning of texts.

Every line is judged on its own: menus of items between separators, lines of
symbols, lines of capitals, boilerplate phrases, and longer lines that hold no
sentence end are removed. A text is rejected if it fails the base rules (too few
words, or too many words in repeated windows) or if more than ``max_lost`` of
its words went with the removed lines.

Defined results: a null text has no words and no lines and fails the base rules;
an empty line is never removed. Rows that repeat a doc_id are judged each on its
own. Whole texts are read, whatever their length. Columns named like the results
are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import small_batches

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved|copyright (c|©|[0-9])|terms of (use|service)|privacy policy|cookie|subscribe|sign in|log in"
    "|click here|read more|share this|javascript|tous droits réservés|alle rechte vorbehalten|todos los derechos"
)
SEPARATOR = "[|»›•·>]"
UPPER, LOWER = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
SENTENCE_END = r"[.!?…][\"'”’»)\]]*([\x09-\x0D\x20]|$)"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, clean_text string"


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_lost: float = 0.5


def n_repeat_words(words: list, window: int = 8) -> int:
    """Words inside windows that occur twice or more in the text, by exact doubling of window names."""
    if len(words) <= window:
        return 0
    seen: dict = {}
    names = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    width, spans = 1, names
    while width < window:  # names of windows twice as wide, from pairs of names
        reach = min(width, window - width)
        left, right = spans[: len(spans) - reach], spans[reach:]
        spans, counts = np.unique(left * (len(words) + 1) + right, return_inverse=True, return_counts=True)[1:]
        width += reach
        if len(counts) == len(spans):
            return 0
    starts = np.flatnonzero(counts[spans] > 1)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


_count = {k: re.compile(v) for k, v in {"sep": SEPARATOR, "up": UPPER, "low": LOWER, "end": SENTENCE_END, "boiler": BOILERPLATE}.items()}


def line_fails(line: str, n_words: int) -> bool:
    """The rules of a line that has words."""
    if sum(map(line.count, SYMBOLS)) >= n_words:
        return True
    seps = sum(map(line.count, "|»›•·>"))
    if seps >= 2 and 4 * seps >= n_words:
        return True
    if n_words >= 4 and not _count["end"].search(line):
        return True
    if _count["boiler"].search(line.lower()):
        return True
    up = len(_count["up"].findall(line))
    return up >= 20 and up >= 4 * len(_count["low"].findall(line))


def judge(text: str | None, limits: Limits) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines, seen, dups, lost, keep = text.split("\n"), set(), 0, 0, []
    for line in lines:
        k = len(line.encode("utf-8", "replace").split())
        if k:
            dups += line in seen
            seen.add(line)
            if line_fails(line, k):
                lost += k
                continue
        keep.append(line)
    repeats = n_repeat_words(words, limits.window)
    failed = n < limits.min_words or 100 * repeats > limits.max_repeat_percent * n
    kept = not failed and lost <= limits.max_lost * n
    return n, chars, sum(map(text.count, SYMBOLS)), dups, repeats, failed, kept, lost, "\n".join(keep)


def clean(docs: DataFrame, limits: Limits = Limits(), with_text: bool = True) -> DataFrame:  # noqa: B008  (frozen)
    """Add the counts, the verdict and (on request) the text without its failed lines to every row."""
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = SCHEMA if with_text else SCHEMA.rsplit(", ", 1)[0]

    @F.pandas_udf(schema)
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = [judge(t, limits) for t in texts]
        frame = pd.DataFrame(rows, columns=names)
        return frame if with_text else frame.drop(columns="clean_text")

    found = docs.drop(*(n for n in names if n != "text")).withColumn("_lc", judged("text"))
    return found.select("*", "_lc.*").drop("_lc")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT rid, doc_id, text, ws, len(ws) AS n_words FROM w),
spans AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS span
          FROM (SELECT rid, ws, unnest(range(1, n_words - 6)) AS i FROM b WHERE n_words >= 8)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, span) AS c FROM spans) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
l AS (SELECT rid, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw
      FROM (SELECT rid, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM b))),
judged AS (SELECT rid, lw, row_number() OVER (PARTITION BY rid, line ORDER BY k) AS nth,
        len(regexp_extract_all(line, '[#*$%&|<>]')) >= lw
        OR (len(regexp_extract_all(line, '{sep}')) >= 2 AND 4 * len(regexp_extract_all(line, '{sep}')) >= lw)
        OR (lw >= 4 AND NOT regexp_matches(line, '{end}'))
        OR regexp_matches(lower(line), '{boiler}')
        OR (len(regexp_extract_all(line, '{up}')) >= 20
            AND len(regexp_extract_all(line, '{up}')) >= 4 * len(regexp_extract_all(line, '{low}'))) AS bad
      FROM l WHERE lw > 0),
lines AS (SELECT rid, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dups, sum(CASE WHEN bad THEN lw ELSE 0 END) AS lost FROM judged GROUP BY rid),
base AS (SELECT b.doc_id, b.n_words, len(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.dups, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.lost, 0) AS lost
      FROM b LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lost <= 0.5 * n_words AS kept FROM v
""".replace("{sep}", SEPARATOR).replace("{end}", SENTENCE_END.replace("'", "''")).replace("{boiler}", BOILERPLATE).replace("{up}", UPPER).replace("{low}", LOWER)  # fmt: skip
