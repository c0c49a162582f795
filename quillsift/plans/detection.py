"""Queries of the detection operators over documents, profiles, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import boxes, entity
from quillsift.functions import patterns as P
from quillsift.operators import detect, fuse, names, ocr, redact, sanitize, stages
from quillsift.sources import html, tables
from quillsift.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PROFILES = tables.PROFILE.replace("{S}", "VARCHAR").replace("{NL}", "chr(10)").replace("{T}", "customer")


def ctes(source: str) -> str:
    """src, lines (doc_id, ln, line, ws, j), words (with wi and word) and boxed in DuckDB."""
    return f"""src AS ({source}),
lines AS (SELECT *, array_to_string(ws, ' ') AS j FROM (SELECT doc_id, ln, line, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM src)))),
words AS (SELECT doc_id, ln, ws, j, unnest(range(len(ws))) AS wi, unnest(ws) AS word FROM lines),
boxed AS (SELECT doc_id, ln, wi, word, 8.0 * p0 AS x0, 20.0 * ln AS y0, 8.0 * (p0 + len(word)) AS x1, 20.0 * ln + 12.0 AS y1
  FROM (SELECT *, CASE WHEN wi = 0 THEN 0 ELSE len(array_to_string(ws[1:wi], ' ')) + 1 END AS p0 FROM words))"""


DOCS = "SELECT doc_id, text FROM documents"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(load(spark, sf_dir, "documents"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(tables.profiles(spark, sf_dir))


@query("words", f"WITH {ctes(DOCS)} SELECT doc_id, ln, wi, word FROM words")
def words(spark, sf_dir):
    return tables.words(documents(spark, sf_dir))


@query("lines", f"WITH {ctes(DOCS)} SELECT doc_id, ln, len(ws) AS n_words, j AS joined FROM lines WHERE len(ws) > 0")
def lines(spark, sf_dir):
    out = documents(spark, sf_dir).filter(F.size("ws") > 0)
    return out.select("doc_id", "ln", F.size("ws").cast("long").alias("n_words"), F.array_join("ws", " ").alias("joined"))


@query("word_boxes", f"WITH {ctes(PROFILES)} SELECT * FROM boxed")
def word_boxes(spark, sf_dir):
    return tables.word_boxes(profiles(spark, sf_dir))


@query("validate_input", """SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '.png' WHEN doc_id % 3 = 1 THEN '.JPEG' ELSE '.gif' END AS name,
  CASE WHEN n_chars <= 0 THEN 'empty' WHEN n_chars * 1000 > 10485760 THEN 'too large' WHEN doc_id % 3 = 2 THEN 'extension' END AS error FROM documents""")
def validate_input(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".png").when(F.col("doc_id") % 3 == 1, ".JPEG").otherwise(".gif"))
    return d.select("doc_id", name.alias("name"), tables.invalid_reason(name, F.col("n_chars") * 1000).alias("error"))


def _hits(name: str, kind: str, confidence: str, where: str, length: str = "1", source: str = PROFILES, more: str = "") -> str:
    return (
        f"WITH {ctes(source)}{more} SELECT doc_id, ln, wi, wi + {length} - 1 AS wi_to, '{kind}' AS type, CAST({confidence} AS DOUBLE) AS confidence,"
        f" array_to_string(ws[wi + 1 : wi + {length}], ' ') AS text FROM {'words' if not more else 'w'} WHERE {where}"
    )


_NUM = "regexp_replace(word, '[^0-9]', '', 'g')"
_PLAIN = r"regexp_replace(word, '[\s()-]', '', 'g')"


def _after(label: str) -> str:
    """words with the index of the line's first label."""
    return f", w AS (SELECT *, min(CASE WHEN regexp_matches(word, '(?i)\\b(?:{label})\\b') THEN wi END) OVER (PARTITION BY doc_id, ln) AS head FROM words)"


_LEAD = ", w AS (SELECT *, coalesce(ws[wi], '') AS prev, coalesce(ws[wi + 2], '') AS n1, coalesce(ws[wi + 3], '') AS n2 FROM words)"
_LUHN = (
    "list_sum(list_transform(range(len({w})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({w}[len({w}) - i] AS INT)"
    " ELSE (2 * CAST({w}[len({w}) - i] AS INT)) // 10 + (2 * CAST({w}[len({w}) - i] AS INT)) % 10 END)) % 10 = 0"
)
_CARD = r"regexp_replace(word, '[\s-]', '', 'g')"
_UUID, _JWT = rf"regexp_matches(word, '\b{P.UUID}\b')", f"(regexp_matches(word, '{P.JWT}') OR (starts_with(word, 'eyJ') AND len(word) > 20))"
_CONTEXT = f"len(list_filter(ws, lambda x: regexp_matches(x, '(?i){P.SECRET_CONTEXT}'))) > 0 AND len(word) >= 16 AND regexp_matches(word, '[A-Za-z0-9]')"
_SECRET = (f"CASE WHEN {_UUID} THEN 0.99 WHEN {_JWT} THEN 0.96 ELSE 0.95 END", f"{_UUID} OR {_JWT} OR ({_CONTEXT})")
_CARDS = f"CASE WHEN regexp_matches({_CARD}, '^\\d{{13,19}}$') THEN {_LUHN.replace('{w}', _CARD)} ELSE false END"
_TAIL = f"regexp_matches({_PLAIN}, '{P.PHONE_TAIL}')"
_PAIR = r"(word IN ('+91', '91') AND regexp_matches(regexp_replace(n1, '[\s()-]', '', 'g'), '" + P.PHONE_TAIL + "'))"
_FOUR = "regexp_replace({x}, '[^0-9]', '', 'g')"
#: Where blocks of three words of four digits start in a line, from the left, without overlap.
_STARTS = f"""list_filter(range(len(ws) - 2), lambda i: len({_FOUR.format(x="ws[i + 1]")}) = 4 AND len({_FOUR.format(x="ws[i + 2]")}) = 4 AND len({_FOUR.format(x="ws[i + 3]")}) = 4
  AND regexp_matches({_FOUR.format(x="ws[i + 1]")}, '^[2-9]'))"""
_BLOCKS = f""", s AS (SELECT doc_id, ln, {_STARTS} AS starts FROM lines),
g AS (SELECT doc_id, ln, CASE WHEN len(starts) > 0 THEN list_reduce(list_transform(starts, lambda x: [x]), lambda a, b: CASE WHEN b[1] >= a[len(a)] + 3 THEN list_concat(a, b) ELSE a END) ELSE [] END AS firsts FROM s),
w AS (SELECT words.*, list_contains(firsts, wi) AS triple FROM words JOIN g USING (doc_id, ln))"""
_TRIPLE = "triple"
_KEPT = r"regexp_replace(word, '[:.\s\-]', '', 'g')"
_LABELLED = {
    "roll": ("roll_number", "0.98", P.ROLL_LABEL, f"len({_NUM}) BETWEEN 6 AND 12"),
    "registration": ("id_number", "0.97", P.REGISTRATION_LABEL, "(regexp_matches(word, '[A-Za-z0-9]{2,}/[0-9]{4,}') OR regexp_matches(word, '^[A-Za-z0-9]{6,14}$'))"),
    "centre": ("id_number", "0.95", P.CENTRE_LABEL, f"len({_NUM}) BETWEEN 5 AND 8"),
    "names": ("private_person", "0.98", P.NAME_LABEL, f"len({_KEPT}) > 0 AND {_KEPT} NOT IN ('1', '2', '3') AND NOT regexp_matches(word, '(?i){P.NAME_SKIP}')"),
}
_DETECT = {
    "email": _hits("email", "private_email", "0.99", f"regexp_matches(word, '^{P.EMAIL}$')"),
    "phone": _hits("phone", "private_phone", "0.98", f"{_PAIR} OR (regexp_matches({_PLAIN}, '{P.PHONE}') AND NOT (wi > 0 AND prev IN ('+91', '91') AND {_TAIL}))", f"(CASE WHEN {_PAIR} THEN 2 ELSE 1 END)", more=_LEAD),
    "pan": _hits("pan", "pan", "0.96", f"regexp_matches(upper(word), '{P.PAN}')"),
    "aadhaar": _hits("aadhaar", "aadhaar", "0.97", f"regexp_matches(word, '{P.AADHAAR}') OR {_TRIPLE}", f"(CASE WHEN {_TRIPLE} THEN 3 ELSE 1 END)", more=_BLOCKS),
    "ifsc": _hits("ifsc", "ifsc", "0.96", f"regexp_matches(upper(word), '{P.IFSC}')"),
    "gstin": _hits("gstin", "gstin", "0.96", f"regexp_matches(upper(word), '{P.GSTIN}')"),
    "account": _hits("account", "account_number", "0.97", f"len(list_filter(ws, lambda x: regexp_matches(x, '(?i)\\b(?:{P.ACCOUNT_CONTEXT})\\b'))) > 0 AND len({_NUM}) BETWEEN 9 AND 18"),
    "secret": _hits("secret", "secret", *_SECRET),
    "card": _hits("card", "credit_card", "0.98", _CARDS),
    "customer_id": _hits("customer_id", "id_number", "0.98", f"regexp_matches(j, '(?i)\\b(?:{P.CUSTOMER_LABEL})\\b') AND len({_NUM}) BETWEEN 6 AND 16 AND NOT regexp_matches(word, '(?i)\\b(?:{P.CUSTOMER_LABEL})\\b')"),
    **{k: _hits(k, t, c, f"wi > head AND {v}", more=_after(label)) for k, (t, c, label, v) in _LABELLED.items()},
}
for _name, _sql in _DETECT.items():
    QUERIES[f"detect_{_name}"] = lambda spark, sf_dir, n=_name: detect.detect(profiles(spark, sf_dir), n)
    ORACLES[f"detect_{_name}"] = _sql

#: Identity numbers between marks, two that overlap, and names after titles, for each customer.
MARKED = """SELECT c_custkey AS doc_id, concat('Aadhaar: 2', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), ', 67-89, (0123).', chr(10),
  '2345 6789 0123 4567 ', CASE WHEN c_custkey % 2 = 0 THEN '8901 2345' ELSE '89012 2345' END, chr(10), 'x1345 6789 0123', chr(10),
  'Name : ', CASE c_custkey % 3 WHEN 0 THEN 'श्री' WHEN 1 THEN 'श्रीमती' ELSE 'S/O' END, ' Rahul Sharma') AS text FROM customer"""


def _marked(spark, sf_dir):
    made = MARKED.replace("VARCHAR", "STRING").replace("chr(10)", "char(10)").replace("FROM customer", "FROM {t}")
    return tables.lines(spark.sql(made, t=_customers(spark, sf_dir)))


for _name in ("aadhaar", "names"):
    QUERIES[f"detect_{_name}_marked"] = lambda spark, sf_dir, n=_name: detect.detect(_marked(spark, sf_dir), n)
    ORACLES[f"detect_{_name}_marked"] = _DETECT[_name].replace(PROFILES, MARKED)

_JOINED = f"""WITH {ctes(PROFILES)}, m AS (SELECT doc_id, ln, ws, unnest(regexp_extract_all(array_to_string(ws, ''), '{P.EMAIL}')) AS m FROM lines),
p AS (SELECT doc_id, ln, ws, m, list_filter(range(len(ws)), lambda i: contains(m, regexp_replace(ws[i + 1], '[@.]', '', 'g'))) AS part FROM m)
SELECT doc_id, ln, part[1] AS wi, part[len(part)] AS wi_to, 'private_email' AS type, CAST(0.98 AS DOUBLE) AS confidence, array_to_string(list_transform(part, lambda i: ws[i + 1]), ' ') AS text FROM p WHERE len(part) >= 2"""
SPLIT_MAIL = "SELECT c_custkey AS doc_id, concat('mail user', c_custkey, ' @shop.example', chr(10), 'to me a', c_custkey, '@b.com') AS text FROM customer"


@query("detect_email_joined", _JOINED.replace(PROFILES, SPLIT_MAIL))
def detect_email_joined(spark, sf_dir):
    made = F.concat(F.lit("mail user"), "c_custkey", F.lit(" @shop.example\nto me a"), "c_custkey", F.lit("@b.com"))
    return detect.detect_email_joined(tables.lines(_customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), made.alias("text"))))


_LABEL, _STOP, _LAND = (rf"(?i)\b(?:{x})\b" if i != 1 else rf"(?i){x}" for i, x in enumerate((P.ADDRESS_LABEL, P.ADDRESS_STOP, P.ADDRESS_LANDMARK)))
_ADDRESS = f"""WITH {ctes(PROFILES)},
l AS (SELECT doc_id, ln, ws, j, regexp_matches(j, '{_LABEL}') AS own,
  coalesce(list_min(list_filter(range(len(ws)), lambda i: regexp_matches(ws[i + 1], '{_LABEL}'))), -1) AS head FROM lines WHERE len(ws) > 0),
b AS (SELECT *, sum(CASE WHEN own THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS block,
  CASE WHEN own THEN list_filter(range(len(ws)), lambda i: i > head AND len(regexp_replace(ws[i + 1], '[:.\\s\\-]', '', 'g')) > 0) END AS mine FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY ln) - 1 AS k,
  CASE WHEN own AND len(mine) > 0 THEN CASE WHEN mine[1] = 0 THEN 0 ELSE 8 * (len(array_to_string(ws[1:mine[1]], ' ')) + 1) END END AS lft FROM b),
s AS (SELECT *, max(CASE WHEN k > 0 AND regexp_matches(j, '{_STOP}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY ln) AS stopped,
  coalesce(last_value(lft IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln), 0) AS minx FROM k),
t AS (SELECT *, CASE WHEN own THEN mine ELSE list_filter(range(len(ws)), lambda i: minx = 0 OR (CASE WHEN i = 0 THEN 0 ELSE 8 * (len(array_to_string(ws[1:i], ' ')) + 1) END) >= minx - 35) END AS taken
  FROM s WHERE block > 0 AND k <= 3 AND (own OR (stopped = 0 AND (regexp_matches(j, '{_LAND}') OR regexp_matches(j, '{P.ADDRESS_PLAIN}')))))
SELECT doc_id, ln, taken[1] AS wi, taken[len(taken)] AS wi_to, 'private_address' AS type, CAST(CASE WHEN own THEN 0.96 ELSE 0.95 END AS DOUBLE) AS confidence,
  array_to_string(list_transform(taken, lambda i: ws[i + 1]), ' ') AS text FROM t WHERE len(taken) > 0"""
LETTERS = "SELECT c_custkey AS doc_id, concat('Address : ', c_custkey, ' MG Road', chr(10), '          Ward 12 India', chr(10), 'left     Nagar Colony', chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'Phone : 1' ELSE '          plain text' END, chr(10), '          Sector 9') AS text FROM customer"


@query("detect_address", _ADDRESS)
def detect_address(spark, sf_dir):
    return detect.detect_address(profiles(spark, sf_dir))


FORMS = """SELECT c_custkey AS doc_id, concat('Roll Registration Centre', chr(10), 2400000 + c_custkey, ' AB12/', 10000 + c_custkey, ' ', 700000 + c_custkey) AS text FROM customer"""
_BELOW = {
    "roll": (P.ROLL_LABEL, f"len({_NUM}) BETWEEN 6 AND 12", 55, "roll_number", "0.98"),
    "registration": (P.REGISTRATION_LABEL, "(regexp_matches(word, '[A-Za-z0-9]{2,}/[0-9]{4,}') OR regexp_matches(word, '^[A-Za-z0-9]{5,14}$'))", 55, "id_number", "0.97"),
    "centre": (P.CENTRE_LABEL, f"len({_NUM}) BETWEEN 5 AND 8", 40, "id_number", "0.95"),
}
_BELOW_SQL = {
    name: f"""WITH {ctes(FORMS)},
h AS (SELECT doc_id, ln AS hl, wi AS hw, (x0 + x1) / 2 AS mid, y1 AS hy FROM boxed WHERE regexp_matches(word, '(?i)\\b(?:{label})\\b')),
c AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id, hl, hw ORDER BY ln, wi) AS n FROM boxed b JOIN h USING (doc_id)
  WHERE {value} AND abs((x0 + x1) / 2 - mid) < {far} AND y0 - hy > 4 AND y0 - hy < 75)
SELECT DISTINCT doc_id, ln, wi, wi AS wi_to, '{kind}' AS type, CAST({conf} AS DOUBLE) AS confidence, word AS text, x0, y0, x1, y1 FROM c WHERE n = 1"""
    for name, (label, value, far, kind, conf) in _BELOW.items()
}


def _forms(spark, sf_dir):
    made = FORMS.replace("chr(10)", "char(10)").replace("FROM customer", "FROM {t}")
    return tables.word_boxes(tables.lines(spark.sql(made, t=_customers(spark, sf_dir))))


for _name, _sql in _BELOW_SQL.items():
    QUERIES[f"detect_{_name}_below"] = lambda spark, sf_dir, n=_name: detect.detect_below(_forms(spark, sf_dir), n)
    ORACLES[f"detect_{_name}_below"] = _sql

_THREE = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type FROM words WHERE {w}" for k, w in (("private_email", f"regexp_matches(word, '^{P.EMAIL}$')"), ("secret", _SECRET[1]), ("credit_card", _CARDS)))
_RISK = "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(t) for t in ts)}) THEN '{r}'" for r, ts in entity.RISKS.items()) + " ELSE 'low' END"


@query("severity_by_type", f"WITH {ctes(DOCS)}, d AS ({_THREE}) SELECT type, {_RISK} AS risk, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY ALL")
def severity_by_type(spark, sf_dir):
    lined = documents(spark, sf_dir)
    found = detect.detect_many(lined, ("email", "secret", "card"))
    out = found.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return out.select("type", entity.risk(F.col("type")).alias("risk"), "n", "n_docs")


def _profile_hits(spark, sf_dir):
    """All that the rules and the name model find in the profiles."""
    return sanitize.detections(tables.profiles(spark, sf_dir))


_NAMES = [f"(?i){a}{names.NAME}" for a, _ in names.ANCHORS]
_FOUND = " UNION ALL ".join(
    """SELECT doc_id, {n} AS phrase, CAST({c} AS DOUBLE) AS confidence, unnest(regexp_extract_all(text, '{p}', 1)) AS s,
  unnest(range(len(regexp_extract_all(text, '{p}', 1)))) AS i FROM src""".replace("{n}", str(n)).replace("{c}", str(c)).replace("{p}", p.replace("'", "''"))
    for n, (p, (_, c)) in enumerate(zip(_NAMES, names.ANCHORS, strict=True))
)
_ANCHORED = f"""WITH {ctes(PROFILES)}, f AS ({_FOUND}),
t AS (SELECT *, trim(regexp_replace(regexp_replace(s, '(?i)\\b(?:{names.ENDS})\\b.*$', ''), '[0-9:;.,()/*\\-]', ' ', 'g')) AS name FROM f)
SELECT doc_id, name, confidence, CAST(phrase AS BIGINT) AS phrase FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY phrase, i) AS n FROM t WHERE len(name) > 2) WHERE n = 1"""
_PLAINED = "regexp_replace(lower({x}), '[^\\p{L}\\p{N}]', '', 'g')"
_SAME = """(ps[i + k + 1] = ts[k + 1] OR (least(len(ps[i + k + 1]), len(ts[k + 1])) >= 3
    AND (starts_with(ps[i + k + 1], ts[k + 1]) OR starts_with(ts[k + 1], ps[i + k + 1]))))"""
#: Names at all their places, by runs of words that are alike; of spans at one place, the first by text.
_ALIGNED = f"""SELECT doc_id, 'private_person' AS type, text, confidence, x0, y0, x1, y1, ln, wi, ln_to, wi_to FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, i, n ORDER BY text) AS nth FROM (
  SELECT doc_id, text, confidence, i, len(ts) AS n, list_min(x0s[i + 1 : i + len(ts)]) AS x0, y0s[i + 1] AS y0, list_max(x1s[i + 1 : i + len(ts)]) AS x1,
    list_max(y0s[i + 1 : i + len(ts)]) + 12.0 AS y1, lns[i + 1] AS ln, wis[i + 1] AS wi, lns[i + len(ts)] AS ln_to, wis[i + len(ts)] AS wi_to FROM (
  SELECT *, unnest(list_filter(range(len(ps) - len(ts) + 1), lambda i: len(list_filter(range(len(ts)), lambda k: NOT {_SAME})) = 0)) AS i FROM (
  SELECT s.doc_id, s.name AS text, s.confidence, d.*, list_filter(list_transform(string_split_regex(s.name, '\\s+'), lambda x: {_PLAINED.replace("{x}", "x")}), lambda x: x <> '') AS ts
  FROM ({{anchored}}) s JOIN (SELECT doc_id AS d, list({_PLAINED.replace("{x}", "word")} ORDER BY ln, wi) AS ps, list(x0 ORDER BY ln, wi) AS x0s, list(x1 ORDER BY ln, wi) AS x1s,
    list(y0 ORDER BY ln, wi) AS y0s, list(ln ORDER BY ln, wi) AS lns, list(wi ORDER BY ln, wi) AS wis FROM boxed GROUP BY doc_id) d ON s.doc_id = d.d))))
WHERE nth = 1"""


def _aligned(source: str) -> str:
    return f"WITH {ctes(source)} " + _ALIGNED.replace("{anchored}", _ANCHORED.replace(PROFILES, source))


def _everything(source: str) -> str:
    """All detections of the rules and the model in DuckDB: (doc_id, ln, wi, ln_to, wi_to, type, confidence, source, risk)."""
    simple = {n: s.replace(PROFILES, source) for n, s in _DETECT.items()}
    inline = simple | {"email_joined": _JOINED.replace(PROFILES, source), "address": _ADDRESS.replace(PROFILES, source)}
    place = {n: detect.ORDER.index(n) for n in inline}
    got = " UNION ALL ".join(f"SELECT {place[n]} AS place, doc_id, ln, wi, wi_to, type, confidence FROM ({q})" for n, q in inline.items())
    parts, seen = [f"inl AS ({got})"], ["inl"]
    for n, q in _BELOW_SQL.items():
        here = detect.ORDER.index(n)
        earlier = " UNION ALL ".join(f"SELECT place, doc_id, ln, wi FROM {t}" for t in seen)
        parts.append(
            f"below_{n} AS (SELECT {here} AS place, doc_id, ln, wi, wi_to, type, confidence FROM ({q.replace(FORMS, source)}) b WHERE NOT EXISTS"
            f" (SELECT 1 FROM ({earlier}) e WHERE e.place <= {here} AND e.doc_id = b.doc_id AND e.ln = b.ln AND e.wi = b.wi))"
        )
        seen.append(f"below_{n}")
    rules = " UNION ALL ".join(f"SELECT doc_id, ln, wi, ln AS ln_to, wi_to, type, confidence, 'rule' AS source FROM {t}" for t in seen)
    model = f"SELECT doc_id, ln, wi, ln_to, wi_to, type, confidence, 'privacy_filter' AS source FROM ({_aligned(source)})"
    return f"WITH {', '.join(parts)} SELECT *, {_RISK} AS risk FROM ({rules} UNION ALL {model})"


_ALL_RISK = _everything(PROFILES)


@query("all_detections", _ALL_RISK)
def all_detections(spark, sf_dir):
    return _profile_hits(spark, sf_dir).select("doc_id", "ln", "wi", "ln_to", "wi_to", "type", "confidence", "source", "risk")


@query("detections_by_risk", f"SELECT doc_id, ln, wi, type FROM ({_ALL_RISK}) WHERE risk = 'critical'")
def detections_by_risk(spark, sf_dir):
    return _profile_hits(spark, sf_dir).filter("risk = 'critical'").select("doc_id", "ln", "wi", "type")


_LEVELS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE risk = '{r}') AS {r}" for r in entity.RANKS)


@query("severity_summary", f"SELECT doc_id, {_LEVELS} FROM ({_ALL_RISK}) GROUP BY doc_id")
def severity_summary(spark, sf_dir):
    return redact.severity(_profile_hits(spark, sf_dir), "doc_id")


@query("audit_log", f"""SELECT doc_id, '1280x800' AS dimensions, total AS detections, critical, high, medium, low, critical < 3 AS sanitized, critical >= 3 AS cloud_exposure,
  CASE WHEN critical >= 3 THEN 'too many secrets' END AS error FROM (SELECT doc_id, {_LEVELS} FROM ({_ALL_RISK}) GROUP BY doc_id)""")
def audit_log(spark, sf_dir):
    safe = F.col("critical") < 3
    about = {"dimensions": F.lit("1280x800")}
    return redact.audit(severity_summary(spark, sf_dir), safe, about, F.when(~safe, "too many secrets"))


_RANK = "CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query("ranked_detections", f"SELECT doc_id, type, ln, wi, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, ln, wi, type, confidence, source, wi_to) AS place FROM ({_ALL_RISK})")
def ranked_detections(spark, sf_dir):
    by = fuse.Window.partitionBy("doc_id").orderBy(entity.rank(F.col("risk")), "ln", "wi", "type", "confidence", "source", "wi_to")
    return _profile_hits(spark, sf_dir).select("doc_id", "type", "ln", "wi", F.row_number().over(by).cast("long").alias("place"))


_CASC = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(l, '{s}')" for s in subs)} THEN '{t}'" for subs, t in entity.CASCADE) + " ELSE 'unknown' END"
#: The distinct words of all documents, read as labels, and the types that these are taken for.
_LABELS = f"""SELECT label, {_CASC} AS type FROM (SELECT label, regexp_replace(lower(label), '[-_\\s]', '_', 'g') AS l FROM (
  SELECT DISTINCT unnest(ws) AS label FROM (SELECT list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)))"""


def _labels(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    found = load(spark, sf_dir, "documents").select(F.explode(words).alias("label")).distinct()
    return found.select("label", entity.normalize(F.col("label")).alias("type"))


@query("normalize_labels", f"SELECT type, count(*) AS n, min(label) AS first FROM ({_LABELS}) GROUP BY type")
def normalize_labels(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.min("label").alias("first"))


@query("tag_labels", f"""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN type = 'token' THEN 'SECRET' WHEN type IN ('private_date', 'private_url', 'unknown') THEN 'SENSITIVE_DATA' ELSE upper(type) END AS tag
  FROM ({_LABELS})) GROUP BY tag""")
def tag_labels(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy(entity.tag(F.col("type")).alias("tag")).agg(F.count("*").alias("n"))


@query("risk_levels", f"SELECT risk, count(*) AS n, count(DISTINCT type) AS types FROM (SELECT type, {_RISK} AS risk FROM ({_LABELS})) GROUP BY risk")
def risk_levels(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy(entity.risk(F.col("type")).alias("risk")).agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"))


@query("policy_eval", f"""SELECT action, custom, count(*) AS n FROM (SELECT CASE WHEN r = 'low' THEN 'allow' ELSE 'mask' END AS action, CASE r WHEN 'high' THEN 'tokenize' WHEN 'low' THEN 'allow' ELSE 'mask' END AS custom
  FROM (SELECT type, {_RISK} AS r FROM ({_LABELS}))) GROUP BY ALL""")
def policy_eval(spark, sf_dir):
    level = entity.risk(F.col("type"))
    judged = _labels(spark, sf_dir).select(entity.action(level).alias("action"), entity.action(level, {"high": "tokenize", "low": "allow"}).alias("custom"))
    return judged.groupBy("action", "custom").agg(F.count("*").alias("n"))


_PAIRS = {
    "a0": "l_orderkey % 90", "a1": "l_partkey % 70", "a2": "l_orderkey % 90 + 10 + l_linenumber * 5", "a3": "l_partkey % 70 + 12",
    "b0": "l_suppkey % 90", "b1": "l_orderkey % 70", "b2": "l_suppkey % 90 + 20 + l_linenumber", "b3": "l_orderkey % 70 + 14",
}
_PAIR_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _PAIRS.items()) + " FROM "


def _pairs(spark, sf_dir):
    made = spark.sql(_PAIR_SQL + "{t}", t=load(spark, sf_dir, "lineitem"))
    return made, tuple(F.col(f"a{i}") for i in range(4)), tuple(F.col(f"b{i}") for i in range(4))


_INTER = "CASE WHEN least(a2, b2) > greatest(a0, b0) AND least(a3, b3) > greatest(a1, b1) THEN (least(a2, b2) - greatest(a0, b0)) * (least(a3, b3) - greatest(a1, b1)) ELSE 0.0 END"


@query("box_iou", f"SELECT l_orderkey, l_linenumber, round(i / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - i), 6) AS iou, b0 >= a0 - 5 AND b1 >= a1 - 5 AND b2 <= a2 + 5 AND b3 <= a3 + 5 AS inside FROM (SELECT *, {_INTER} AS i FROM ({_PAIR_SQL} lineitem))")
def box_iou(spark, sf_dir):
    made, a, b = _pairs(spark, sf_dir)
    return made.select("l_orderkey", "l_linenumber", F.round(boxes.iou(a, b), 6).alias("iou"), boxes.contains(a, b).alias("inside"))


@query("clamp_boxes", f"SELECT l_orderkey, l_linenumber, least(greatest(floor(a0 * 1.3 - 9.5), 0), 100.0) AS x0, least(greatest(floor(a1 * 1.3 - 9.5), 0), 60.0) AS y0, least(greatest(floor(a2 * 1.3 - 9.5), 0), 100.0) AS x1, least(greatest(floor(a3 * 1.3 - 9.5), 0), 60.0) AS y1 FROM ({_PAIR_SQL} lineitem)")
def clamp_boxes(spark, sf_dir):
    made, a, _ = _pairs(spark, sf_dir)
    out = boxes.clamp(tuple(c * 1.3 - 10 for c in a), 100, 60)
    return made.select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(out, ("x0", "y0", "x1", "y1"), strict=True)))


@query("merge_boxes", f"SELECT l_orderkey, min(least(a0, b0)) AS x0, min(least(a1, b1)) AS y0, max(greatest(a2, b2)) AS x1, max(greatest(a3, b3)) AS y1 FROM ({_PAIR_SQL} lineitem) GROUP BY l_orderkey")
def merge_boxes(spark, sf_dir):
    made, a, b = _pairs(spark, sf_dir)
    x0, y0, x1, y1 = boxes.merge(a, b)
    return made.groupBy("l_orderkey").agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


@query("words_in_box", f"WITH {ctes(PROFILES)} SELECT doc_id, zone, count(*) AS n, count(*) >= 4 AS rejected FROM boxed JOIN (VALUES (0, 0.0, 0.0, 200.0, 90.0), (1, 100.0, 100.0, 400.0, 180.0)) z(zone, zx0, zy0, zx1, zy1) ON (x0 + x1) / 2 BETWEEN zx0 AND zx1 AND (y0 + y1) / 2 BETWEEN zy0 AND zy1 WHERE len(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) >= 3 GROUP BY ALL")
def words_in_box(spark, sf_dir):
    boxed = tables.word_boxes(profiles(spark, sf_dir)).filter(F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]", "")) >= 3)
    zones = ((0, 0.0, 0.0, 200.0, 90.0), (1, 100.0, 100.0, 400.0, 180.0))
    inside = F.array(*(F.when(((F.col("x0") + F.col("x1")) / 2).between(a, c) & ((F.col("y0") + F.col("y1")) / 2).between(b, d), F.lit(z)) for z, a, b, c, d in zones))
    each = boxed.select("doc_id", F.explode(F.filter(inside, lambda z: z.isNotNull())).alias("zone"))
    return each.groupBy("doc_id", "zone").agg(F.count("*").alias("n")).withColumn("rejected", F.col("n") >= 4)


@query("scrub_text", f"SELECT doc_id, regexp_replace(regexp_replace(text, '{P.EMAIL}', '<EMAIL>', 'g'), '\\b{P.LONG_NUMBER}\\b', '<NUMBER>', 'g') AS text FROM documents")
def scrub_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", P.scrub(F.col("text")).alias("text"))


@query("anchored_names", _ANCHORED)
def anchored_names(spark, sf_dir):
    return names.anchored_names(tables.profiles(spark, sf_dir))


def _spans(spark, sf_dir):
    return names.anchored_names(tables.profiles(spark, sf_dir)).select("doc_id", F.lit("private_person").alias("type"), F.col("name").alias("text"), "confidence")


@query("align_spans", f"SELECT doc_id, type, text, confidence, x0, y0, x1, y1 FROM ({_aligned(PROFILES)})")
def align_spans(spark, sf_dir):
    return names.align(_spans(spark, sf_dir), tables.word_boxes(profiles(spark, sf_dir))).drop("words")


_EXACT = f"""{_ANCHORED.replace("SELECT doc_id, name, confidence, CAST(phrase AS BIGINT) AS phrase FROM", ", spans AS (SELECT doc_id, name AS text FROM", 1).rstrip()}),
c AS (SELECT doc_id, ln, list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS cs FROM lines),
m AS (SELECT c.doc_id, ln, text, cs, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS ts FROM c JOIN spans USING (doc_id)),
p AS (SELECT doc_id, ln, text, ts, cs, unnest(range(len(cs) - len(ts) + 1)) AS wi FROM m WHERE len(cs) >= len(ts))
SELECT doc_id, text, ln, wi, wi + len(ts) - 1 AS wi_to FROM p WHERE cs[wi + 1 : wi + len(ts)] = ts"""


@query("align_exact", _EXACT)
def align_exact(spark, sf_dir):
    return names.align_exact(_spans(spark, sf_dir), tables.word_boxes(profiles(spark, sf_dir)))


@query("decode_logits", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def decode_logits(spark, sf_dir):
    best = F.array_position("embedding", F.array_max("embedding")) - 1
    return load(spark, sf_dir, "embeddings").select("vec_id", best.cast("long").alias("best"))


@query("decode_spans", """WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations),
l AS (SELECT *, trim(token) <> '' AND token SIMILAR TO '.*[a-e]' AS lit FROM w),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l WHERE lit)
SELECT doc_id, 'name' AS label, text, CAST(0.95 AS DOUBLE) AS confidence, pos, pos_to FROM (
  SELECT doc_id, string_agg(trim(token), ' ' ORDER BY pos) AS text, min(pos) AS pos, max(pos) AS pos_to FROM g GROUP BY doc_id, run) WHERE len(text) > 1""")
def decode_spans(spark, sf_dir):
    """Words that end in a to e are labelled as one name from the first to the last of a run."""
    said = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    label = F.when((F.trim("token") != "") & F.col("token").rlike(r"^.*[a-e]$"), F.when(F.col("pos") % 2 == 0, "B-Name").otherwise("I-name")).otherwise("O")
    return names.decode_spans(said.withColumn("pos", F.col("pos").cast("long")).withColumn("label", label))


@query("fused_profiles")
def fused_profiles(spark, sf_dir):
    """The whole union of the profiles' detections, fused."""
    return sanitize.fused(_profile_hits(spark, sf_dir))


_PARTS = """SELECT l_orderkey AS doc_id, l_linenumber AS detector, l_partkey % 3 AS slot, CASE l_suppkey % 4 WHEN 0 THEN 'pan' WHEN 1 THEN 'secret' WHEN 2 THEN 'private_date' ELSE 'unknown' END AS type,
  CASE l_linenumber % 2 WHEN 0 THEN 'rule' ELSE 'privacy_filter' END AS source, CAST(0.90 + l_linenumber % 3 * 0.02 AS DOUBLE) AS confidence FROM """
_REGIONS = f"""SELECT doc_id, slot, type, list(source ORDER BY confidence DESC, source, detector) AS found, max(confidence) AS top,
  arg_min(row(source, detector), row(-confidence, source, detector)) AS base, count(*) AS n_merged FROM ({_PARTS} lineitem) GROUP BY doc_id, slot, type"""
_FUSED = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY top DESC, base, slot, type) AS seq, type, {_RISK} AS risk, array_to_string(list_distinct(found).list_sort(), '+') AS sources, n_merged,
  round(CASE WHEN len(list_distinct(found)) > 1 THEN least(0.99, top + 0.02) ELSE top END, 2) AS confidence, CAST(slot * 100 AS DOUBLE) AS x0,
  CASE WHEN len(list_distinct(found)) > 1 THEN 'Text (OCR + Model + Rule)' WHEN found[1] = 'rule' THEN 'Text (OCR + Rule)' ELSE 'Text (OCR + Model)' END AS detail FROM ({_REGIONS})"""


def _fused(spark, sf_dir):
    """Regions of detections that share a box or lie far apart."""
    made = spark.sql(_PARTS + "{t}", t=load(spark, sf_dir, "lineitem"))
    x = (F.col("slot") * 100).cast("double")
    boxed = made.withColumns({"x0": x, "y0": F.lit(0.0), "x1": x + 50, "y1": F.lit(12.0)})
    return fuse.fuse(fuse.arrived(boxed, "detector", "slot", "type"))


@query("fuse", _FUSED)
def fused(spark, sf_dir):
    return _fused(spark, sf_dir).select("doc_id", "seq", "type", "risk", F.array_join(F.array_sort("sources"), "+").alias("sources"), "n_merged", "confidence", "x0", "detail")


@query("redaction_manifest", f"""SELECT doc_id, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE risk = '{r}') AS {r}" for r in entity.RANKS)}, 'PROTECTED' AS status, count(*) AS regions,
  string_agg(concat('<', CASE WHEN type IN ('private_date', 'unknown') THEN 'SENSITIVE_DATA' ELSE upper(type) END, '_0', seq, '>'), ' '
    ORDER BY CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, seq) AS tokens FROM ({_FUSED}) GROUP BY doc_id""")
def redaction_manifest(spark, sf_dir):
    """The documents' counts, and what is read back from the JSON."""
    made = redact.manifest(_fused(spark, sf_dir), about={"filename": F.concat("doc_id", F.lit(".png"))})
    back = F.from_json("manifest", "privacyStatus string, summary struct<totalRegions: bigint>, detections array<struct<token: string>>")
    out = made.withColumn("b", back)
    return out.select("doc_id", "total", *entity.RANKS, F.col("b.privacyStatus").alias("status"), F.col("b.summary.totalRegions").alias("regions"), F.array_join("b.detections.token", " ").alias("tokens"))


def _masked(source: str, token: str) -> str:
    """Texts in DuckDB with the words of all detections that are masked replaced; {token} may name the least token t of a word."""
    seq = "concat('<', CASE WHEN type = 'token' THEN 'SECRET' WHEN type IN ('private_date', 'private_url', 'unknown') THEN 'SENSITIVE_DATA' ELSE upper(type) END, '_0', seq, '>')"
    return f"""WITH {ctes(source)}, hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln, wi, wi_to, type) AS seq FROM ({_everything(source)}) WHERE risk <> 'low'),
m AS (SELECT w.doc_id, w.ln, w.wi, min({seq}) AS t FROM words w JOIN hits h ON w.doc_id = h.doc_id AND (w.ln > h.ln OR (w.ln = h.ln AND w.wi >= h.wi)) AND (w.ln < h.ln_to OR (w.ln = h.ln_to AND w.wi <= h.wi_to))
  GROUP BY w.doc_id, w.ln, w.wi),
r AS (SELECT w.doc_id, w.ln, string_agg(coalesce({token}, w.word), ' ' ORDER BY w.wi) AS new, count(t) AS n FROM words w LEFT JOIN m ON m.doc_id = w.doc_id AND m.ln = w.ln AND m.wi = w.wi GROUP BY w.doc_id, w.ln)
SELECT l.doc_id, string_agg(CASE WHEN r.n > 0 THEN r.new ELSE l.line END, chr(10) ORDER BY l.ln) AS text, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS n_masked
FROM lines l LEFT JOIN r ON r.doc_id = l.doc_id AND r.ln = l.ln GROUP BY l.doc_id"""


_CLEAN = f"CASE WHEN t IS NOT NULL THEN '{redact.BLOCK}' END"


@query("redact_clean", f"SELECT doc_id, text FROM ({_masked(PROFILES, _CLEAN)})")
def redact_clean(spark, sf_dir):
    return redact.mask(tables.profiles(spark, sf_dir), sanitize.masked_words(_profile_hits(spark, sf_dir)))


@query("redact_tagged", f"SELECT doc_id, text FROM ({_masked(PROFILES, 't')})")
def redact_tagged(spark, sf_dir):
    hits = _profile_hits(spark, sf_dir).filter(F.col("action") != "allow")
    hits = hits.withColumn("seq", F.row_number().over(fuse.Window.partitionBy("doc_id").orderBy("ln", "wi", "wi_to", "type")))
    token = F.concat(F.lit("<"), entity.tag(F.col("type")), F.lit("_0"), "seq", F.lit(">"))
    each = hits.select("doc_id", token.alias("token"), F.inline("words")).select("doc_id", "ln", "wi", F.col("wi").alias("wi_to"), "token")
    return redact.mask(tables.profiles(spark, sf_dir), each)


@query("sanitize", f"""SELECT d.doc_id, m.text, d.text IS NOT NULL AS sanitized, CASE WHEN d.text IS NULL THEN 'no text' END AS error, coalesce(m.n_masked, 0) AS n_masked
  FROM documents d LEFT JOIN ({_masked(DOCS, _CLEAN)}) m ON m.doc_id = d.doc_id""")
def sanitized(spark, sf_dir):
    """The documents on the whole way: all detections, masked by the policy, with an error where that can't be."""
    return sanitize.sanitize(load(spark, sf_dir, "documents")).select("doc_id", "text", "sanitized", "error", "n_masked")


@query("stage_counts", f"""SELECT 'loading' AS stage, count(*) AS n_rows FROM documents UNION ALL SELECT 'model', count(*) FROM ({_everything(DOCS)}) WHERE source = 'privacy_filter'
  UNION ALL SELECT 'rules', count(*) FROM ({_everything(DOCS)}) WHERE source = 'rule' UNION ALL SELECT 'fusion', count(DISTINCT doc_id) FROM ({_everything(DOCS)})
  UNION ALL SELECT 'redaction', count(*) FROM documents UNION ALL SELECT 'total', count(*) FROM documents""")
def stage_counts(spark, sf_dir):
    """The documents sanitized stage by stage: how many rows each stage wrote."""
    docs, run = load(spark, sf_dir, "documents"), stages.Run()
    run.sanitize(docs)
    return run.table(docs).select("stage", "n_rows")


@query("base64_roundtrip", "SELECT doc_id, to_base64(encode(text)) AS code, text AS back FROM documents")
def base64_roundtrip(spark, sf_dir):
    code = F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\r\n", "")
    return load(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.decode(F.unbase64(code), "utf-8").alias("back"))


_SLANT = "y0 + x0 / 300"


@query("ocr_lines", f"""WITH {ctes(PROFILES)}, b AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS row FROM boxed)
SELECT doc_id, row AS ln, wi, word FROM b""")
def ocr_lines(spark, sf_dir):
    """Words in no order, on slanted lines, grouped into lines again."""
    boxed = tables.word_boxes(profiles(spark, sf_dir))
    slanted = boxed.withColumns({"seq": F.xxhash64("word", "ln", "wi"), "y1": F.expr("y1 + x0 / 300"), "y0": F.expr(_SLANT)})
    return ocr.group_lines(slanted).select("doc_id", "ln", "wi", "word")


def _rows(ln: str) -> str:
    """Line numbers without those of lines that hold no word."""
    return f"(SELECT doc_id, ln, dense_rank() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS row FROM lines WHERE len(ws) > 0) r ON r.doc_id = h.doc_id AND r.ln = h.{ln}"


_READ = " UNION ALL ".join(
    f"SELECT {detect.ORDER.index(n)} AS place, doc_id, ln, wi, wi_to, type, confidence FROM ({q})" for n, q in (*_DETECT.items(), ("email_joined", _JOINED)) if n not in _BELOW_SQL
)


@query("ocr_detections", f"WITH {ctes(PROFILES)}, hits AS ({_READ}) SELECT h.doc_id, r.row AS ln, h.wi, h.wi_to, h.type, h.confidence FROM hits h JOIN {_rows('ln')}")
def ocr_detections(spark, sf_dir):
    """The hits of the word detectors that don't look below labels, on words that were grouped from their boxes."""
    boxed = tables.word_boxes(profiles(spark, sf_dir)).withColumn("seq", F.xxhash64("word", "ln", "wi"))
    found = ocr.detect_words(ocr.group_lines(boxed))
    skip = [detect.ORDER.index(n) for n in detect.VERTICAL]
    return found.filter(~F.col("detector").isin(*skip)).select("doc_id", "ln", "wi", "wi_to", "type", "confidence")


_PHRASES = " OR ".join(f"contains(t, '{p}')" for p in P.CONFIRMATIONS)


@query("confirmation_pages", f"""SELECT page_id, {_PHRASES} AS confirmed FROM (SELECT page_id, lower(trim(regexp_replace(replace(regexp_replace(html[strpos(html, '<body>') :],
  '<!--.*?-->|<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))[1:6000]) AS t FROM (SELECT page_id, replace(html, '</ul>', CASE WHEN contains(url, '.org') THEN '</ul>Thanks for <i>filling</i>  out this form' ELSE '</ul>' END) AS html FROM pages))""")
def confirmation_pages(spark, sf_dir):
    """Pages that say that a form has been sent, in what they show first; those of one domain are made to."""
    said = F.when(F.contains("url", F.lit(".org")), "</ul>Thanks for <i>filling</i>  out this form").otherwise("</ul>")
    made = load(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</ul>"), said).alias("html"))
    made = made.withColumn("there", F.col("html").isNotNull())
    found = html.forms(made, ("there",), ("amp",))  # as the twin counts them
    return found.select("page_id", F.when(F.col("there"), html.confirmed(F.col("shown"), P.CONFIRMATIONS)).alias("confirmed"))
