"""Regular expressions of the detectors and the text rules around them.

The patterns assume ASCII word edges. Java's ``\\b`` follows Unicode, so
``edged`` writes the edges out.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the detectors.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"^(?:\+?91[\s-]?)?[6-9]\d{9}$"
PHONE_TAIL = r"^[6-9]\d{9}$"
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
AADHAAR = r"^[2-9]{1}[0-9]{11}$"
IFSC = r"^[A-Z]{4}0[A-Z0-9]{6}$"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
JWT = r"^eyJ[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+(\.[A-Za-z0-9-_.+/=]*)?$"
SECRET_CONTEXT = r"token|api|key|secret|password|bearer|auth"
ACCOUNT_CONTEXT = r"account|acct|a\/c|saving|savings|current|khaata|khata"
CUSTOMER_LABEL = r"customer\s*id|cust\s*id|customer|cif(?:\s*no|\s*number)?|micr(?:\s*code)?|member(?:\s*id)?"
NAME_LABEL = r"name|customer\s*name|holder(?:\s*name)?|account\s*holder|applicant"
NAME_SKIP = r"^(?:S\/O|D\/O|W\/O|C\/O|SO|DO|WO|CO|श्री|श्रीमती)$"
ROLL_LABEL = r"roll(?:\s*no|\s*number)?"
REGISTRATION_LABEL = r"registration|enrolment|enrollment|regn|reg\.?\s*no"
CENTRE_LABEL = r"centre(?:\s*no)?|school(?:\s*no)?|school\/centre"
ADDRESS_LABEL = r"address|addr|br\.\s*address|cust\.\s*address"
ADDRESS_STOP = r"(?:operational|nomination|scheme|queries|toll|open\s*dt|branch|account|ifsc|micr|phone|mobile|pan|aadhaar)\s*[:.\s\-]"
ADDRESS_LANDMARK = r"ward|vill|teh|distt|post|nagar|colony|road|rd|street|marg|sector|opp|bus\s*stand|chhattisgarh|india|\d{6}"
ADDRESS_PLAIN = r"^[A-Za-z0-9\s,.\-]+$"
LONG_NUMBER = r"(?:\+?\d[\d\s-]{8,}\d)"
HINDI_LABELS = {
    "name": "नाम", "address": "पता", "roll": r"अनुक्रमांक|रोल\s*नं|रोल\s*नंबर", "registration": "पंजीयन|नामांकन", "centre": "केंद्र|शाला",
}
CONFIRMATIONS = (
    "response has been recorded", "response was recorded", "recorded your response", "response has been submitted",
    "your response has been received", "submit another response", "thanks for filling out this form",
    "thank you for completing", "thank you for your submission", "form submitted",
)


def edged(words: str, extra: str | None = None) -> str:
    """Any of ``words`` between ASCII word edges, whatever the case; ``extra``: more words, without edges."""
    core = rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
    return rf"(?i)(?:{core}|{extra})" if extra else rf"(?i){core}"


_BLANKS = r" \t\n\x0b\f\r"
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def automaton(pattern: str) -> str:
    """A pattern of this module as Arrow's automaton takes it: with edges as characters, and ``\\s`` as in Java."""
    spaced = lambda m: m[0].replace(r"\s", _BLANKS) if m[0][0] == "[" else f"[{_BLANKS}]" if m[0] == r"\s" else m[0]
    plain = pattern.replace(_BEFORE, "(?:^|[^A-Za-z0-9_])").replace(_AFTER, "(?:$|[^A-Za-z0-9_])")
    return re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", spaced, plain)


def may_hold(text: Column, *patterns: str) -> Column:
    """Whether ``text`` holds a match of any of ``patterns``: never false where it does.

    One walk over the bytes of a batch of texts, whatever the number of patterns,
    where Java tries each of them at each place. By bytes, a letter that isn't ASCII
    may also match another one; so this is a gate before the patterns themselves.
    """
    every = "|".join(f"(?:{automaton(p)})" for p in dict.fromkeys(patterns))

    @F.arrow_udf("boolean")
    def held(texts: pa.Array) -> pa.Array:
        kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
        return pc.match_substring_regex(texts.cast(kind), every)

    return held(text)


def quoted(pattern: str) -> str:
    """A pattern as a literal of Spark SQL."""
    if "'" in pattern:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"r'{pattern}'"


def digits(word: Column) -> Column:
    return F.regexp_replace(word, r"[^0-9]", "")


def between(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


def scrub(text: Column) -> Column:
    """Mail addresses, then runs of ten or more digits, replaced by tags."""
    # the pattern EMAIL, tried once a run of its characters: what fails at the first of them fails at all
    once = EMAIL.replace("]+@", "]++@", 1)
    mailed = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, rf"(?:\G|(?<![A-Za-z0-9._%+-])){once}", "<EMAIL>")).otherwise(text)
    # a sign may stand behind a word, a digit may not
    return F.regexp_replace(mailed, r"(?:\+\d|\d(?<![A-Za-z0-9_]\d))[\d\s-]{8,}\d(?![A-Za-z0-9_])", "<NUMBER>")
