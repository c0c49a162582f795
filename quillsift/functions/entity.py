"""Entity types: normalising labels, tags, risks, policy and source details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a label and the type each stands for; the first that is found wins.
CASCADE = (
    (("email",), "private_email"), (("phone", "mobile", "tel"), "private_phone"), (("person", "name"), "private_person"),
    (("address", "street"), "private_address"), (("pan",), "pan"), (("aadhaar", "aadhar", "uid"), "aadhaar"), (("ifsc",), "ifsc"),
    (("gstin", "gst"), "gstin"), (("account",), "account_number"), (("credit_card", "card_number"), "credit_card"),
    (("token", "jwt", "bearer"), "token"), (("api_key", "secret", "password"), "secret"), (("face", "photo", "avatar"), "face"),
    (("qr", "qr_code"), "qr_code"), (("barcode",), "barcode"), (("signature", "sign"), "signature"), (("roll",), "roll_number"),
    (("registration", "enrollment", "enrol"), "id_number"), (("date",), "private_date"), (("url",), "private_url"),
)
RISKS = {
    "critical": ("secret", "password", "api_key", "token", "credit_card"),
    "high": ("pan", "aadhaar", "ifsc", "account_number", "private_email", "private_phone", "face", "signature", "qr_code", "roll_number", "id_number"),
    "medium": ("private_person", "private_address", "private_url", "gstin"),
    "low": ("private_date", "barcode", "fingerprint", "unknown"),
}
TAGS = {"token": "SECRET", "private_date": "SENSITIVE_DATA", "private_url": "SENSITIVE_DATA", "unknown": "SENSITIVE_DATA"}
RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3}
POLICY = {"critical": "mask", "high": "mask", "medium": "mask", "low": "allow"}
TYPES = tuple(t for types in RISKS.values() for t in types)


def _cases(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), otherwise)


def normalize(label: Column) -> Column:
    plain = F.regexp_replace(F.lower(label), r"[-_\s]", "_")
    return _cases([(reduce(Column.__or__, (F.contains(plain, F.lit(s)) for s in subs)), t) for subs, t in CASCADE], F.lit("unknown"))


def tag(kind: Column) -> Column:
    return _cases([(kind == k, t) for k, t in TAGS.items()], F.upper(kind))


def risk(kind: Column) -> Column:
    return _cases([(kind.isin(*types), r) for r, types in RISKS.items()], F.lit("low"))


def rank(level: Column) -> Column:
    return reduce(lambda rest, p: F.when(level == p[0], p[1]).otherwise(rest), RANKS.items(), F.lit(9))


def action(level: Column, policy: dict[str, str] | None = None) -> Column:
    """The policy's action; a level that the policy doesn't name is masked."""
    return _cases([(level == r, a) for r, a in (POLICY if policy is None else policy).items()], F.lit("mask"))


# What is said of a region's sources; a visual region's kind tells it apart.
VISUAL_DETAILS = {"face": "Face (Visual)", "qr_code": "Visual", "signature": "Signature (Visual)"}
DETAILS = {"rule + privacy_filter": "Text (OCR + Model + Rule)", "privacy_filter": "Text (OCR + Model)", "rule": "Text (OCR + Rule)", "": "Text (OCR)"}


def source_detail(kind: Column, sources: Column) -> Column:
    has = lambda s: F.array_contains(sources, s)
    seen = _cases([(kind == k, d) for k, d in VISUAL_DETAILS.items()], F.lit("Visual"))
    read = F.when(has("rule") & has("privacy_filter"), DETAILS["rule + privacy_filter"]).when(has("privacy_filter"), DETAILS["privacy_filter"])
    return F.when(has("visual"), seen).otherwise(read.when(has("rule"), DETAILS["rule"]).otherwise(DETAILS[""]))
