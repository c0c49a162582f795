"""Token counts of sections from one encoding of the whole document.

A document is encoded once. The character span of every token is joined with the
spans of the document's sections, and each token is given to sections by an
explicit rule:

* ``majority``: wholly to the section that holds most of its characters, the
  first of them on a tie;
* ``start``: wholly to the section that holds its first character;
* ``split``: to all sections it touches, in proportion to the characters.

A token that holds some bytes of a character only counts as spanning it whole.
Tokens outside all sections are counted under the label ``(none)``, so that the
counts of a document always add up to its tokens.

Defined results: a null or empty text has no tokens; its document still has one
row, of label ``(none)`` with zero counts. Rows that repeat a doc_id are counted
each on its own. Any length of text is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillsift.llm.common import small_batches

#: Default place of the public vocabulary; the same path must exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that splits texts for this vocabulary, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NONE = "(none)"

Section = tuple[int, int, str]


@functools.cache
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file and the byte length of each of its tokens."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of every token."""
    encoding, sizes = encoder(vocabulary)
    ends = np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text), dtype=np.int64)])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    if len(ends) and ends[-1] == len(text):  # ASCII: bytes are characters
        return starts, ends
    lead = (np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    return char[starts] if len(ends) else starts, char[ends - 1] + 1 if len(ends) else ends


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[Section], rule: str) -> np.ndarray:
    """Tokens given to each section, and last to none of them. Sections ascend and don't overlap."""
    given = np.zeros(len(sections) + 1)
    if not len(starts):
        return given
    if not sections:
        given[-1] = len(starts)
        return given
    lo, hi = np.array([s[0] for s in sections]), np.array([s[1] for s in sections])
    first, last = np.searchsorted(hi, starts, "right"), np.searchsorted(lo, ends, "left") - 1
    inside = (first == last) & (lo[np.minimum(first, len(lo) - 1)] <= starts) & (ends <= hi[np.minimum(first, len(hi) - 1)])
    given[: len(sections)] += np.bincount(first[inside], minlength=len(sections))[: len(sections)]
    for t in np.flatnonzero(~inside):  # tokens at a boundary
        s, e = int(starts[t]), int(ends[t])
        shares = [(max(0, min(e, sections[k][1]) - max(s, sections[k][0])), k) for k in range(int(first[t]), int(last[t]) + 1)]
        outside = (e - s) - sum(n for n, _ in shares)
        if rule == "split":
            for n, k in [*shares, (outside, -1)]:
                given[k] += n / (e - s)
        elif rule == "start":
            given[next((k for _, k in shares if sections[k][0] <= s < sections[k][1]), -1)] += 1
        else:
            most = max((n for n, _ in shares), default=0)
            given[next(k for n, k in shares if n == most) if most and most >= outside else -1] += 1
    return given


_TABLE = re.compile(r" \| ")


def line_sections(text: str) -> list[Section]:
    """Lines with their line breaks: the first one ``lead``, lines of cells ``table``, others ``body``."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            out.append((at, end, "lead" if i == 0 else "table" if _TABLE.search(line) else "body"))
        at = end
    return out


def attribute(docs: DataFrame, sections: Callable[[str], list[Section]] = line_sections, rule: str = "majority", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section (label), n_sections, n_chars and n_tokens for each label of a document."""
    if rule not in ("majority", "start", "split"):
        raise ValueError(f"no such rule: {rule}")
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text if isinstance(text, str) else ""
                spans = sections(text)
                given = allocate(*token_spans(text, vocabulary), spans, rule)
                by: dict[str, list] = {}
                for (s, e, label), n in zip(spans, given, strict=False):
                    x = by.setdefault(label, [0, 0, 0.0])
                    x[0], x[1], x[2] = x[0] + 1, x[1] + e - s, x[2] + n
                if given[-1] or not spans:
                    by[NONE] = [0, len(text) - sum(e - s for s, e, _ in spans), given[-1]]
                rows += [(doc_id, label, *x) for label, x in by.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "n_sections", "n_chars", "n_tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(counted, "doc_id long, section string, n_sections long, n_chars long, n_tokens double")
