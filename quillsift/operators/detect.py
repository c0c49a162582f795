"""Rule detectors: lines of words to detections.

Each detector works on a line's array of words, so no detector shuffles. One
regular expression on the whole line, of all the detectors asked for, leaves out
the lines that can't have a hit before they are split into words; ``detect_all``
searches texts and then lines for it by one automaton. The vertical search of
labels above values is the only join, within a document.

A doc_id names one document: hits, lines and boxes are joined by it, so rows that
repeat one would be taken for one text. Callers number such rows first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.functions import entity
from quillsift.functions import patterns as P
from quillsift.sources import tables


q = P.quoted


def _first_label(pattern: str) -> str:
    """Index of the first label on the line, or null."""
    return f"nullif(array_position(transform(ws, w -> rlike(w, {q(pattern)})), true), 0) - 1"


_DIGITS = r"regexp_replace({}, r'[^0-9]', '')"
#: Where three words of four digits each start, whatever stands between the digits, taken from the left without overlap.
_TRIPLES = f"""CASE WHEN size(ws) >= 3 AND size(filter(ws, w -> length({_DIGITS.format("w")}) = 4)) >= 3 THEN aggregate(
  filter(sequence(0, size(ws) - 3), i -> length({_DIGITS.format("ws[i]")}) = 4 AND length({_DIGITS.format("ws[i + 1]")}) = 4
    AND length({_DIGITS.format("ws[i + 2]")}) = 4 AND rlike({_DIGITS.format("ws[i]")}, '^[2-9]')),
  named_struct('free', 0, 'at', cast(array() AS array<int>)),
  (a, i) -> CASE WHEN i >= a.free THEN named_struct('free', i + 3, 'at', array_append(a.at, i)) ELSE a END).at
  ELSE cast(array() AS array<int>) END"""


@dataclass(frozen=True)
class Rule:
    """A detector of words, in SQL: ``line`` is computed once a line, under the name given, and ``hit`` on its words.

    Words come as wi, word, prev, n1 and n2 (their neighbours, empty at the ends).
    """

    kind: str
    confidence: str
    line: tuple[str, str] | None
    hit: str
    length: str = "1"  # how many words it takes
    may: str = "rlike(word, '[0-9]')"  # what every word that is hit meets, and is cheap to tell


def rules(unicode_labels: bool = False) -> dict[str, Rule]:
    more = P.HINDI_LABELS if unicode_labels else {}
    without = lambda chars, x="word": f"regexp_replace({x}, {q(chars)}, '')"
    like = lambda pattern, x="word": f"rlike({x}, {q(pattern)})"
    size = lambda low, high: f"length({_DIGITS.format('word')}) BETWEEN {low} AND {high}"
    some = lambda pattern: f"exists(ws, w -> {like(pattern, 'w')})"
    marks = r"[\s()-]"
    kept, card, customer = without(r"[:.\s\-]"), without(r"[\s-]"), P.edged(P.CUSTOMER_LABEL)
    is_uuid, is_jwt = like(P.edged(P.UUID)), f"({like(P.JWT)} OR (startswith(word, 'eyJ') AND length(word) > 20))"
    pair = f"(word IN ('+91', '91') AND {like(P.PHONE_TAIL, without(marks, 'n1'))})"
    partner = f"(wi > 0 AND prev IN ('+91', '91') AND {like(P.PHONE_TAIL, without(marks))})"
    triple = "array_contains(_triples, cast(wi AS int))"

    def labelled(name: str, kind: str, confidence: float, label: str, value: str) -> Rule:
        head = f"_head_{name}"
        return Rule(kind, f"{confidence}D", (head, _first_label(P.edged(label, more.get(name)))), f"wi > {head} AND {value}", may=f"coalesce(wi > {head}, false)")

    return {
        "email": Rule("private_email", "0.99D", None, like(f"^{P.EMAIL}$"), may="contains(word, '@')"),
        "phone": Rule("private_phone", "0.98D", None, f"{pair} OR ({like(P.PHONE, without(marks))} AND NOT {partner})", f"CASE WHEN {pair} THEN 2 ELSE 1 END"),
        "pan": Rule("pan", "0.96D", None, like(P.PAN, "upper(trim(word))")),
        "aadhaar": Rule("aadhaar", "0.97D", ("_triples", _TRIPLES), f"{like(P.AADHAAR)} OR {triple}", f"CASE WHEN {triple} THEN 3 ELSE 1 END"),
        "ifsc": Rule("ifsc", "0.96D", None, like(P.IFSC, "upper(trim(word))")),
        "gstin": Rule("gstin", "0.96D", None, like(P.GSTIN, "upper(trim(word))")),
        "account": Rule("account_number", "0.97D", ("_account", some(P.edged(P.ACCOUNT_CONTEXT))), f"_account AND {size(9, 18)}"),
        "roll": labelled("roll", "roll_number", 0.98, P.ROLL_LABEL, size(6, 12)),
        "registration": labelled("registration", "id_number", 0.97, P.REGISTRATION_LABEL, f"({like(r'[A-Za-z0-9]{2,}\/[0-9]{4,}')} OR {like(r'^[A-Za-z0-9]{6,14}$')})"),
        "centre": labelled("centre", "id_number", 0.95, P.CENTRE_LABEL, size(5, 8)),
        "secret": Rule(
            "secret", f"CASE WHEN {is_uuid} THEN 0.99D WHEN {is_jwt} THEN 0.96D ELSE 0.95D END", ("_context", some(rf"(?i)(?:{P.SECRET_CONTEXT})")),
            f"(length(word) >= 16 AND ({is_uuid} OR {is_jwt} OR (_context AND {like('[A-Za-z0-9]')}))) OR (startswith(word, 'eyJ') AND {is_jwt})", may="(length(word) >= 16 OR startswith(word, 'eyJ'))",
        ),
        "card": Rule("credit_card", "0.98D", None, f"CASE WHEN {like(r'^\d{13,19}$', card)} THEN luhn_check({card}) ELSE false END"),
        "customer_id": Rule("id_number", "0.98D", ("_customer", like(customer, "array_join(ws, ' ')")), f"_customer AND {size(6, 16)} AND NOT {like(customer)}"),
        "names": labelled("name", "private_person", 0.98, P.NAME_LABEL, f"length({kept}) > 0 AND {kept} NOT IN ('1', '2', '3') AND NOT {like(f'(?i){P.NAME_SKIP}')}"),
    }


def gates(unicode_labels: bool = False) -> dict[str, str]:
    """For each detector, an expression that every line with a hit matches as a whole."""
    more = P.HINDI_LABELS if unicode_labels else {}
    labels = {"roll": P.ROLL_LABEL, "registration": P.REGISTRATION_LABEL, "centre": P.CENTRE_LABEL, "name": P.NAME_LABEL}
    label = {k: P.edged(v, more.get(k)) for k, v in labels.items()}
    return {
        "email": "@", "phone": r"[6-9](?:[()\-]*\d){9}", "pan": r"\d{4}", "aadhaar": r"[2-9](?:\D*\d){11}", "ifsc": "0", "gstin": r"\d{4}",
        "account": P.edged(P.ACCOUNT_CONTEXT), "roll": label["roll"], "registration": label["registration"], "centre": label["centre"],
        "secret": rf"{P.UUID}|eyJ|(?i:{P.SECRET_CONTEXT})", "card": r"\d(?:-*\d){12}", "customer_id": P.edged(P.CUSTOMER_LABEL), "names": label["name"],
    }


def may_hit(names: tuple[str, ...], unicode_labels: bool = False) -> Column:
    """Whether a line can have a hit of any of the detectors: one search for all of them."""
    known = gates(unicode_labels)
    return F.col("line").rlike("|".join(f"(?:{g})" for g in dict.fromkeys(known[n] for n in names)))


def sifted_lines(docs: DataFrame, names: tuple[str, ...], unicode_labels: bool = False) -> DataFrame:
    """``tables.lines`` of whole texts, of the lines that may have a hit: first the texts are searched, then the lines of those left."""
    known = gates(unicode_labels)
    wanted = [known[n] for n in names]
    return tables.lines(docs.filter(P.may_hold(F.col("text"), *wanted))).filter(P.may_hold(F.col("line"), *wanted))


#: The order in which detectors run; later ones see what earlier ones found.
ORDER = ("email", "email_joined", "phone", "pan", "aadhaar", "ifsc", "gstin", "account", "roll", "registration", "centre", "secret", "card", "customer_id", "names", "address")


BOX = ("x0", "y0", "x1", "y1")


#: The box of the words wi to wi_to of a line with cells.
_EDGES = (
    f"{tables.CHAR}D * cells[cast(wi AS int)].at AS x0", f"{tables.PITCH}D * ln AS y0",
    f"{tables.CHAR}D * (cells[cast(wi_to AS int)].at + length(cells[cast(wi_to AS int)].word)) AS x1", f"{tables.PITCH}D * ln + {tables.HEIGHT} AS y1",
)
_WORDS = """inline(transform(ws, (w, i) -> named_struct('wi', cast(i AS bigint), 'word', w,
  'prev', coalesce(get(ws, i - 1), ''), 'n1', coalesce(get(ws, i + 1), ''), 'n2', coalesce(get(ws, i + 2), ''))))"""


def _boxed(hits: DataFrame) -> DataFrame:
    """The boxes of hits (ln, wi, wi_to) of lines with cells."""
    return hits.selectExpr(*(c for c in hits.columns if c != "cells"), *_EDGES)


def detect_many(lined: DataFrame, names: tuple[str, ...], unicode_labels: bool = False, boxed: bool = False, sifted: bool = False) -> DataFrame:
    """(detector, doc_id, ln, wi, wi_to, type, confidence, text) of several detectors' hits, in one pass over the words.

    ``boxed`` adds the boxes of the hits, made of the lines alone. ``sifted`` says that lines without a hit have been left out.
    """
    known = rules(unicode_labels)
    chosen = {n: known[n] for n in names}
    facts = {r.line[0]: r.line[1] for r in chosen.values() if r.line}
    gated = (lined if sifted else lined.filter(may_hit(names, unicode_labels))).filter("size(ws) > 0")
    gated = tables.with_cells(gated) if boxed else gated
    held = ("cells",) if boxed else ()
    cells = gated.selectExpr("*", *(f"{e} AS {k}" for k, e in facts.items())).selectExpr("doc_id", "ln", *held, *facts, _WORDS)

    def told(n: str, r: Rule) -> str:
        text = f"CASE {r.length} WHEN 3 THEN concat_ws(' ', word, n1, n2) WHEN 2 THEN concat_ws(' ', word, n1) ELSE word END"
        return f"named_struct('detector', '{n}', 'wi_to', wi + {r.length} - 1, 'type', '{r.kind}', 'confidence', {r.confidence}, 'text', {text})"

    if len(chosen) == 1:
        ((n, r),) = chosen.items()
        found = cells.filter(r.hit).selectExpr("doc_id", "ln", "wi", *held, f"{told(n, r)} AS h").select("doc_id", "ln", "wi", *held, "h.*")
    else:
        cells = cells.filter(" OR ".join(dict.fromkeys(r.may for r in chosen.values())))
        hits = ", ".join(f"CASE WHEN {r.hit} THEN {told(n, r)} END" for n, r in chosen.items())
        found = cells.selectExpr("doc_id", "ln", "wi", *held, f"inline(filter(array({hits}), h -> h IS NOT NULL))")
    return (_boxed(found) if boxed else found).select("detector", "doc_id", "ln", "wi", "wi_to", "type", "confidence", "text", *(BOX if boxed else ()))


def detect(lined: DataFrame, name: str, unicode_labels: bool = False) -> DataFrame:
    """(doc_id, ln, wi, wi_to, type, confidence, text) of one detector's hits inside lines."""
    return detect_many(lined, (name,), unicode_labels).drop("detector")


def detect_email_joined(lined: DataFrame, boxed: bool = False) -> DataFrame:
    """Mail addresses split over words of a line: the words that take part, first to last."""
    glued = lined.filter("contains(line, '@')").selectExpr("*", f"explode(regexp_extract_all(array_join(ws, ''), {q(P.EMAIL)}, 0)) AS m")
    part = "filter(transform(ws, (w, i) -> named_struct('i', cast(i AS bigint), 'ok', contains(m, regexp_replace(w, '[@.]', '')))), x -> x.ok) AS part"
    hits = glued.selectExpr("*", part).filter("size(part) >= 2")
    hits = tables.with_cells(hits) if boxed else hits
    found = hits.selectExpr(
        "doc_id", "ln", *(("cells",) if boxed else ()), "part[0].i AS wi", "part[size(part) - 1].i AS wi_to", "'private_email' AS type", "0.98D AS confidence",
        "array_join(transform(part, x -> ws[cast(x.i AS int)]), ' ') AS text",
    )
    return _boxed(found) if boxed else found


#: Where word i of a line starts, in pixels, and the words after the label.
_LEFT = r"""8 * length(array_join(slice(split(line, r'(?<=\s)(?=\S)'), 1, CASE WHEN rlike(line, r'^\s') THEN {i} + 1 ELSE {i} END), ''))"""
_SAYS = r"length(regexp_replace({w}, r'[:.\s\-]', '')) > 0"


def detect_address(lined: DataFrame, boxed: bool = False) -> DataFrame:
    """Words after an address label, and up to three aligned lines below it until a stop word."""
    label = P.edged(P.ADDRESS_LABEL)
    line = lined.filter("size(ws) > 0").selectExpr("doc_id", "ln", "line", "ws", "array_join(ws, ' ') AS j")
    line = line.selectExpr("*", f"rlike(j, {q(label)}) AS own").selectExpr("*", f"CASE WHEN own THEN coalesce({_first_label(label)}, -1) END AS at")
    line = line.selectExpr("*", "sum(cast(own AS bigint)) OVER (PARTITION BY doc_id ORDER BY ln) AS block")
    line = line.selectExpr("*", "row_number() OVER (PARTITION BY doc_id, block ORDER BY ln) - 1 AS k")
    stop = f"k > 0 AND rlike(j, {q(f'(?i){P.ADDRESS_STOP}')})"
    line = line.selectExpr("*", f"max({stop}) OVER (PARTITION BY doc_id, block ORDER BY ln) AS stopped").filter("block > 0 AND k <= 3")
    after = f"filter(sequence(0, size(ws) - 1), i -> i > at AND {_SAYS.format(w='ws[i]')})"
    line = line.selectExpr("*", f"CASE WHEN own THEN array_min(transform({after}, i -> {_LEFT.format(i='i')})) END AS left_")
    line = line.selectExpr("*", "coalesce(last(left_, true) OVER (PARTITION BY doc_id ORDER BY ln), 0) AS min_x")
    going = f"NOT own AND NOT stopped AND (rlike(j, {q(P.edged(P.ADDRESS_LANDMARK))}) OR rlike(j, {q(P.ADDRESS_PLAIN)}))"
    taken = f"""filter(transform(ws, (w, i) -> named_struct('i', cast(i AS bigint), 'w', w)), x -> CASE WHEN own THEN x.i > at AND {_SAYS.format(w='x.w')}
      ELSE min_x = 0 OR {_LEFT.format(i='cast(x.i AS int)')} >= min_x - 35 END) AS taken"""
    hits = line.filter(f"own OR ({going})").selectExpr("*", taken).filter("size(taken) > 0")
    hits = tables.with_cells(hits) if boxed else hits
    found = hits.selectExpr(
        "doc_id", "ln", *(("cells",) if boxed else ()), "taken[0].i AS wi", "taken[size(taken) - 1].i AS wi_to", "'private_address' AS type",
        "CASE WHEN own THEN 0.96D ELSE 0.95D END AS confidence", "array_join(transform(taken, x -> x.w), ' ') AS text",
    )
    return _boxed(found) if boxed else found


#: Label, value test, furthest distance of the middles, type and confidence of each vertical search; fixed values.
VERTICAL: dict[str, tuple[str, Callable[[Column], Column], int, str, float]] = {
    "roll": (P.ROLL_LABEL, lambda w: P.between(P.digits(w), 6, 12), 55, "roll_number", 0.98),
    "registration": (P.REGISTRATION_LABEL, lambda w: w.rlike(r"[A-Za-z0-9]{2,}\/[0-9]{4,}") | w.rlike(r"^[A-Za-z0-9]{5,14}$"), 55, "id_number", 0.97),
    "centre": (P.CENTRE_LABEL, lambda w: P.between(P.digits(w), 5, 8), 40, "id_number", 0.95),
}


#: How far above a value its label's lower edge may lie: over LOW and under HIGH pixels; fixed values.
LOW, HIGH = 4, 75


def below(boxed: DataFrame, names: tuple[str, ...] = tuple(VERTICAL)) -> DataFrame:
    """(name, doc_id, ln, wi, word, x0..y1): of each label of each kind, the first word in reading order below it that looks like its value; each word once a kind.

    A band join: the page is cut into cells as high as a label reaches down and as
    wide as it reaches to a side. A value lies in one cell and a label is dealt to
    those that it reaches, six at most, so that the join has equal keys and a label
    meets only what is near. Labels are never sent whole to all tasks: their number
    can't be told from the table that the words are made of.
    """
    each = lambda test: F.explode(F.array(*(F.when(test(n), F.lit(n)) for n in names))).alias("name")
    far = F.create_map(*(F.lit(x) for n in names for x in (n, float(VERTICAL[n][2]))))
    mid, word = (F.col("x0") + F.col("x1")) / 2, F.col("word")
    span = lambda a, b: F.explode(F.sequence(F.floor(a), F.floor(b)))
    heads = boxed.select("doc_id", F.struct("ln", "wi").alias("head"), mid.alias("mid"), F.col("y1").alias("hy"), each(lambda n: word.rlike(P.edged(VERTICAL[n][0])))).filter("name IS NOT NULL")
    heads = heads.withColumn("far", far[F.col("name")]).withColumn("row", span((F.col("hy") + LOW) / HIGH, (F.col("hy") + HIGH) / HIGH))
    heads = heads.withColumn("col", span((F.col("mid") - F.col("far")) / F.col("far"), (F.col("mid") + F.col("far")) / F.col("far")))
    cells = boxed.select("doc_id", "ln", "wi", "word", *BOX, mid.alias("own"), each(lambda n: VERTICAL[n][1](word))).filter("name IS NOT NULL")
    cells = cells.withColumns({"row": F.floor(F.col("y0") / HIGH), "col": F.floor(F.col("own") / far[F.col("name")])})
    gap = F.col("y0") - F.col("hy")
    near = (F.abs(F.col("own") - F.col("mid")) < F.col("far")) & (gap > LOW) & (gap < HIGH)
    met = cells.join(heads.hint("merge"), ["doc_id", "name", "row", "col"]).filter(near)
    first = met.groupBy("doc_id", "name", "head").agg(F.min(F.struct("ln", "wi", "word", *BOX)).alias("v"))
    once = first.groupBy("doc_id", "name", "v.x0", "v.y0").agg(F.min("v").alias("v"))
    return once.select("name", "doc_id", "v.*")


def detect_below(boxed: DataFrame, name: str, earlier: DataFrame | None = None) -> DataFrame:
    """The hits of one kind of ``below``, unless ``earlier`` (doc_id, x0, y0) has them."""
    _, _, _, kind, confidence = VERTICAL[name]
    hits = below(boxed, (name,))
    if earlier is not None:
        hits = hits.join(earlier.select("doc_id", "x0", "y0"), ["doc_id", "x0", "y0"], "left_anti")
    return hits.select("doc_id", "ln", "wi", F.col("wi").alias("wi_to"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.col("word").alias("text"), *BOX)


def _placed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("detector", F.array_position(F.array(*map(F.lit, ORDER)), F.col("detector")).cast("int") - 1)


def with_below(hits: DataFrame, boxed: DataFrame) -> DataFrame:
    """Boxed hits and those below labels among ``boxed``, unless an earlier detector has one that starts in that place; detectors by number."""
    kinds = {k: F.create_map(*(F.lit(x) for n, v in VERTICAL.items() for x in (n, v[i])))[F.col("name")] for i, k in ((3, "type"), (4, "confidence"))}
    found = below(boxed)
    found = found.select(F.col("name").alias("detector"), "doc_id", "ln", "wi", F.col("wi").alias("wi_to"), *(c.alias(k) for k, c in kinds.items()), F.col("word").alias("text"), *BOX)
    out = _placed(hits.withColumn("_below", F.lit(False)).unionByName(found.withColumn("_below", F.lit(True))))
    first = F.row_number().over(Window.partitionBy("doc_id", "x0", "y0").orderBy("detector", "_below"))
    return out.repartition("doc_id").withColumn("_n", first).filter(~F.col("_below") | (F.col("_n") == 1)).drop("_n", "_below")


def detect_all(docs: DataFrame, vertical: bool = True, unicode_labels: bool = False) -> DataFrame:
    """All rule detections with boxes, arrival order, risk and action.

    Everything but the search below labels is made of single lines, or runs of lines
    of documents that have an address label. A word below a label is a hit unless an
    earlier detector has one that starts in its place, which one window tells.
    """
    simple = tuple(n for n in ORDER if n not in ("email_joined", "address"))
    labelled = lambda *labels: docs.filter(P.may_hold(F.col("text"), *map(P.edged, labels)))
    mailed = tables.lines(docs.filter(F.contains("text", F.lit("@"))))
    out = detect_many(sifted_lines(docs, simple, unicode_labels), simple, unicode_labels, boxed=True, sifted=True)
    out = out.unionByName(detect_email_joined(mailed, boxed=True).withColumn("detector", F.lit("email_joined")))
    out = out.unionByName(detect_address(tables.lines(labelled(P.ADDRESS_LABEL)), boxed=True).withColumn("detector", F.lit("address")))
    out = with_below(out, tables.word_boxes(tables.lines(labelled(*(v[0] for v in VERTICAL.values()))))) if vertical else _placed(out)
    level = entity.risk(F.col("type"))
    return out.withColumn("source", F.lit("rule")).withColumn("risk", level).withColumn("action", entity.action(F.col("risk")))
