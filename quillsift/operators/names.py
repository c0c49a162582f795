"""Names after fixed phrases, and the alignment of found spans with words."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.functions import patterns as P
from quillsift.sources import tables

# The phrases before a name, each with its confidence, and the words that end one.
NAME = r"([A-Za-zऀ-ॿ]{2,}(?:\s+[A-Za-zऀ-ॿ]{2,}){1,3})"
ANCHORS = (
    (r"(?:(?:SHRI\s*\/?\s*SMT\.?\s*\/?\s*KUM\.?|श्री\s*\/?\s*श्रीमती\s*\/?\s*कुमारी|श्रीमती|कुमारी|श्री)\s*[:.\s\-]+)\s*", 0.99),
    (r"(?:CERTIFIED\s+THAT|प्रमाणित\s+किया\s+जाता\s+है\s+कि)\s+", 0.99),
    (r"(?:CANDIDATE(?:'S)?\s+NAME|STUDENT(?:'S)?\s+NAME|परीक्षार्थी\s+का\s+नाम)\s*[:.\s\-]+\s*", 0.99),
    (r"(?:(?:is\s+hereby\s+|is\s+)?(?:presented|awarded|conferred\s+upon|given)\s+to|(?:this\s+is\s+to\s+)?certif(?:y|ied)\s+that)\s*[:.\s\-]*\s*", 0.99),
    (r"(?:MOTHER(?:'S)?\s+NAME(?:\s+IS\s+SMT\.?)?|माता\s+का\s+नाम(?:\s+श्रीमती)?)\s*[:.\s\-]+\s*", 0.98),
    (r"(?:FATHER(?:'S)?(?:\s*\/\s*HUSBAND(?:'S)?)?\s+NAME(?:\s+IS\s+SHRI\.?)?|पिता\s*(?:\/\s*पति)?\s*का\s+नाम(?:\s+श्री)?)\s*[:.\s\-]+\s*", 0.98),
)
ENDS = "FOR|IN|DURING|ON|WHO|WITH|DATED|AT|FROM|OF|HAS|APPEARED|SUCCESSFULLY|WHOSE|FATHER|MOTHER|DATE|ROLL|REGISTRATION|NO|IS"


def _anchored() -> Column:
    """All names after the phrases in ``text``, with the phrase's number, the place among its finds and its confidence."""
    def found(n: int, anchor: str, confidence: float) -> Column:
        hits = F.regexp_extract_all("text", F.lit(f"(?i){anchor}{NAME}"), F.lit(1))
        return F.transform(hits, lambda s, i: F.struct(F.lit(n).alias("p"), i.alias("i"), named(s).alias("name"), F.lit(confidence).alias("c")))

    def named(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(s, rf"(?i)\b(?:{ENDS})\b.*$", ""), r"[0-9:;.,()/*\-]", " "))

    return F.filter(F.flatten(F.array(*(found(n, *a) for n, a in enumerate(ANCHORS)))), lambda x: F.length(x["name"]) > 2)


def anchored_names(docs: DataFrame) -> DataFrame:
    """(doc_id, name, confidence): the first of each name, whatever its case, in the order of the phrases."""
    out = docs.select("doc_id", F.inline(_anchored()))
    once = F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy("p", "i"))
    return out.withColumn("_n", once).filter("_n = 1").select("doc_id", "name", F.col("c").alias("confidence"), F.col("p").cast("long").alias("phrase"))


def _clean(word: str) -> str:
    return re.sub(r"[\W_]", "", "".join(c for c in word.lower() if c.isalnum()))


def _same(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)))


# Words of one line start no further apart than LINE; boxes nearer than SAME on all sides are one.
LINE, SAME = 22, 5


class Tokens:
    """A trie of the tokens of all spans, walked over words from each place on.

    Branches are found by the first three letters, which are all that two words that
    are alike must share; each is then tried by ``_same``.
    """

    def __init__(self, spans: list[list[str]]) -> None:
        self.root: dict = {}
        for n, tokens in enumerate(spans):
            node = self.root
            for t in tokens:
                node = node.setdefault(t[:3], {}).setdefault(t, {})
            if tokens:
                node.setdefault(None, []).append(n)

    def found(self, plain: list[str]) -> dict[int, list[int]]:
        """The places, ascending, from which on the words match each span."""
        out: dict[int, list[int]] = {}
        for i in range(len(plain)):
            k, nodes = i, [self.root]
            while nodes and k < len(plain):
                p = plain[k]
                nodes = [below for node in nodes for t, below in node.get(p[:3], {}).items() if _same(p, t)]
                k += 1
                for node in nodes:
                    for n in node.get(None, ()):
                        out.setdefault(n, []).append(i)
        return out


class _Inside:
    """Words that hold a string, found by one search of all words."""

    def __init__(self, plain: list[str]) -> None:
        self.plain, self.joined = plain, "\n".join(plain)
        self.starts = list(itertools.accumulate((len(p) + 1 for p in plain), initial=0))

    def of(self, part: str) -> Iterator[int]:
        at = self.joined.find(part)
        while at >= 0:
            i = bisect.bisect_right(self.starts, at) - 1
            yield i
            at = self.joined.find(part, self.starts[i + 1])


def place(words: list[str], box: list[tuple[float, float, float, float]], spans: list[tuple[str, str, float]]) -> list[tuple]:
    """(type, text, confidence, box, first and last word) of every occurrence of each span, split where it goes on to another line.

    ``words`` of one document in reading order; first and last are places in it.
    """
    plain = [_clean(w) for w in words]
    tokens = [[t for t in map(_clean, text.split()) if t] for _, text, _ in spans]
    hits, inside = Tokens(tokens).found(plain), None
    out: list[tuple] = []
    seen: dict[str, dict] = {}

    def add(kind: str, text: str, confidence: float, first: int, last: int) -> None:
        start = first
        for k in range(first + 1, last + 2):
            if k > last or abs(box[k][1] - box[start][1]) >= LINE:
                part = box[start:k]
                b = (*(float(min(p[c] for p in part)) for c in (0, 1)), *(float(max(p[c] for p in part)) for c in (2, 3)))
                cell = tuple(int(x // SAME) for x in b)
                near = seen.setdefault(kind, {})
                around = (o for c in itertools.product(*((x - 1, x, x + 1) for x in cell)) for o in near.get(c, ()))
                if not any(all(abs(x - y) < SAME for x, y in zip(o, b, strict=True)) for o in around):
                    near.setdefault(cell, []).append(b)
                    out.append((kind, text, confidence, *b, start, k - 1))
                start = k

    for n, (kind, text, confidence) in enumerate(spans):
        own, glued = hits.get(n, []), "".join(tokens[n])
        if not own and len(glued) >= 3:
            # a span whose words don't follow each other may stand in one word
            inside = inside or _Inside(plain)
            held = [i for i in inside.of(glued)]
            if len(glued) >= 4:
                own = [i for i in held if plain[i] == glued or len(plain[i]) >= 6]
            if not own and len(tokens[n]) == 1:
                own = [i for i in held if plain[i] == glued or len(glued) >= 4]
            for i in own:
                add(kind, text, confidence, i, i)
            continue
        for i in own:
            add(kind, text, confidence, i, i + len(tokens[n]) - 1)
    return out


def align_rows(words: pd.DataFrame, spans: pd.DataFrame) -> list[tuple]:
    """``place`` of frames: words (word, x0..y1) and spans (type, text, confidence)."""
    return place(words["word"].tolist(), list(words[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), list(spans[["type", "text", "confidence"]].itertuples(index=False, name=None)))


PLACED = "type string, text string, confidence double, x0 double, y0 double, x1 double, y1 double, words array<struct<ln: bigint, wi: bigint>>"
_NAMES = ("type", "text", "confidence", "x0", "y0", "x1", "y1", "words")


def _placed(doc_id: object, words: list[str], boxes: list[tuple], where: list[tuple[int, int]], spans: list[tuple[str, str, float]]) -> Iterator[tuple]:
    for r in place(words, boxes, spans):
        yield doc_id, *r[:-2], [{"ln": ln, "wi": wi} for ln, wi in where[r[-2] : r[-1] + 1]]


def align(spans: DataFrame, boxed: DataFrame) -> DataFrame:
    """Place spans (doc_id, type, text, confidence) on the words of their documents; ``words`` are those of each box.

    Spans and words of a document are sorted next to each other and read as a stream,
    a document at a time.
    """
    held = spans.filter(F.col("doc_id").isNotNull())
    mine = boxed.join(held.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")  # words of documents without spans go nowhere
    none = lambda kind, *cols: {c: F.lit(None).cast(kind) for c in cols}
    box = ("x0", "y0", "x1", "y1")
    rows = held.select("doc_id", "type", "text", "confidence").withColumns(none("long", "ln", "wi") | none("double", *box)).withColumn("side", F.lit(0))
    rows = rows.unionByName(mine.select("doc_id", "ln", "wi", F.col("word").alias("text"), *box).withColumns(none("string", "type") | none("double", "confidence")).withColumn("side", F.lit(1)))
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "side", "ln", "wi", "type", "text", "confidence")

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, words, boxes, where = None, [], [], [], []
        out: list[tuple] = []
        for pdf in batches:
            cols = (pdf[c] for c in ("doc_id", "side", "type", "text", "confidence", "ln", "wi", *box))
            for doc_id, side, kind, text, confidence, ln, wi, *b in zip(*cols, strict=True):
                if doc_id != now:
                    out += _placed(now, words, boxes, where, held)
                    now, held, words, boxes, where = doc_id, [], [], [], []
                if side == 0:
                    held.append((kind, text, confidence))
                else:
                    words.append(text)
                    boxes.append(tuple(b))
                    where.append((int(ln), int(wi)))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", *_NAMES])
                out = []
        out += _placed(now, words, boxes, where, held)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", *_NAMES])

    return dealt.mapInPandas(streamed, f"doc_id {spans.schema['doc_id'].dataType.simpleString()}, {PLACED}")


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def words_of(text: str) -> Iterator[tuple[int, int, str, tuple[float, float, float, float]]]:
    """(line, place in it, word, synthetic box) of a text's words, as ``tables.word_boxes`` has them."""
    for ln, line in enumerate(text.split("\n")):
        top = tables.PITCH * ln
        for wi, m in enumerate(_WORD.finditer(line)):
            yield ln, wi, m[0], (tables.CHAR * m.start(), top, tables.CHAR * m.end(), top + tables.HEIGHT)


def align_texts(docs: DataFrame, kind: str = "private_person") -> DataFrame:
    """Names after the phrases, placed on the words of their own texts (doc_id, text): where a text is, there are its names and words, so nothing is shuffled."""
    # the patterns run on texts with one of the phrases only, once; a filter on what they find would be moved before the search for phrases
    held = docs.filter(P.may_hold(F.col("text"), *(f"(?i){a}" for a, _ in ANCHORS)))
    found = held.select("doc_id", "text", _anchored().alias("names"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, text, names in zip(pdf["doc_id"], pdf["text"], pdf["names"], strict=True):
                first: dict[str, tuple[str, str, float]] = {}
                for x in names:
                    first.setdefault(x["name"].lower(), (kind, x["name"], x["c"]))
                if not first:
                    continue
                cells = list(words_of(text))
                out += _placed(doc_id, [c[2] for c in cells], [c[3] for c in cells], [c[:2] for c in cells], sorted(first.values()))
            yield pd.DataFrame(out, columns=["doc_id", *_NAMES])

    return found.mapInPandas(placed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PLACED}")


def align_exact(spans: DataFrame, boxed: DataFrame) -> DataFrame:
    """Only the exact, one-line matches of ``align``, without Python: doc_id, text, ln, wi, wi_to."""
    plain = F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}]", "")
    line = boxed.groupBy("doc_id", "ln").agg(F.array_sort(F.collect_list(F.struct("wi", plain.alias("p")))).alias("ws"))
    tokens = F.filter(F.transform(F.split("text", r"\s+"), lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")), lambda t: t != "")
    met = line.join(spans.select("doc_id", "text", tokens.alias("ts")).hint("merge"), "doc_id").filter(F.size("ts") > 0)
    fits = F.filter(F.sequence(F.lit(0), F.size("ws") - F.size("ts")), lambda i: F.slice(F.col("ws.p"), i + 1, F.size("ts")) == F.col("ts"))
    met = met.filter(F.size("ws") >= F.size("ts")).withColumn("i", F.explode(fits))
    return met.select("doc_id", "text", "ln", F.col("i").cast("long").alias("wi"), (F.col("i") + F.size("ts") - 1).cast("long").alias("wi_to"))


#: Confidence of a decoded span, a fixed value.
DECODED = 0.95
SPAN = "doc_id long, label string, text string, confidence double, pos long, pos_to long"


def _spans_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of labelled tokens as spans; a document may go on in the next batch."""
    now: list | None = None
    rows: list[tuple] = []

    def close() -> None:
        nonlocal now
        if now is not None:
            text = " ".join(now[2]).strip()
            if len(text) > 1:
                rows.append((now[0], now[1], text, DECODED, now[3], now[4]))
        now = None

    for pdf in batches:
        for doc, pos, label, token in zip(pdf["doc_id"], pdf["pos"], pdf["label"], pdf["token"], strict=True):
            token = (token or "").strip()
            special = (token.startswith("[") and token.endswith("]")) or token in ("<s>", "</s>")
            if now is not None and now[0] != doc:
                close()
            if not label or label == "O" or not token or special:
                close()
                continue
            prefix, kind = (label[0].upper(), label[2:].lower()) if re.match(r"[BIESLbiesl]-", label) else ("", label.lower())
            if now is not None and (prefix in ("I", "E", "S", "L") or now[1] == kind):
                now[2].append(token)
                now[4] = pos
            else:
                close()
                now = [doc, kind, [token], pos, pos]
            if prefix == "E":
                close()
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPAN.split(", ")])
            rows.clear()
    close()
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPAN.split(", ")])


def decode_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, label, text, confidence, pos, pos_to): neighbouring tokens of one label, in tokens (doc_id, pos, label, token).

    Labels may carry the prefixes of a BIOESL scheme: I, E, S and L go on with the
    span before, whatever its label, E ends it, and ``O`` is none. Special tokens,
    in brackets or marking a sequence, end a span too. A span of one character is dropped.
    """
    dealt = tokens.select("doc_id", "pos", "label", "token").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    return dealt.mapInPandas(_spans_of, SPAN)


def best_label(logits: Column, labels: list[str]) -> Column:
    """The label of the greatest logit, the first of equal ones; ``O`` if it has no name."""
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, labels)), F.greatest(at, F.lit(1))), F.lit("O"))
