"""Ranked lexical search over a term-bucketed table of postings.

Each document gives one posting for each of its terms that some item asks for. The
postings lie in buckets, ranges of terms and, inside a term, of documents, so that a
term that most documents hold is dealt over several. Items are joined to them by
term, every match gets an integer score, scores are summed by item and document, and
a window keeps the best.

Frequent terms weigh little but match nearly everything, so they are scored last:

1. the rarest terms of an item score some documents; the k-th best of these sums is
   a bound that no document of the result falls below;
2. an item's weightless terms, as many as can't reach the bound together whatever the
   document, need no scan: a document with none but these isn't in the result. All
   others are joined in full;
3. of the documents found so, those that can still reach the bound get the matches
   of the weightless terms added.

The bound cuts off only what can't be in the result: an item without a bound (fewer
than k matches of its rarest terms) has all its terms joined.

Defined results: terms are maximal runs of ASCII letters and digits and of all
characters beyond ASCII, lower-cased in A-Z only. Null and empty texts have none;
they match nothing and don't count as documents. Rows that repeat a doc_id are
documents of their own, in places next to each other if their scores are equal; a
document without an id comes before all others of its score. Rows that repeat an
item_id are one item with the terms of all; items without an id are one item too.
An item that matches nothing has no row. Extra columns are not looked at. Texts are
read whole, in the task that scans them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.llm.common import materialize, small_batches

#: A term of the contract, for SQL.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items are dealt to all tasks up to so many (item, term) rows; beyond, they are joined by shuffles.
ITEM_ROWS = 1_000_000
#: Matches that the rarest terms of an item may make for the first bound, its rarest term's aside.
SEED_MATCHES = 5_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, with repeats."""
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each term of an item once."""
    small_batches(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("item_id").to_pylist(), b.column("text").to_pylist()
            pairs = [(i, t.decode()) for i, text in zip(ids, out, strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, term string").distinct()


def document_terms(docs: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(r, doc_id, n, cells): number of terms of every document that has one, and how often it holds each term in ``wanted`` (all, if none are given)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = held.value
        cell = pa.struct([("term", pa.string()), ("tf", pa.int64())])
        for b in batches:
            sizes, cells, ends = [], [], [0]
            rows, words, times = [], [], []
            for k, text in enumerate(b.column("text")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                tf = Counter(found if keep is None else [t for t in found if t in keep])
                rows.append(k)
                sizes.append(len(found))
                words += tf.keys()
                times += tf.values()
                ends.append(len(words))
            cells = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], fields=list(cell))
            kept = b.select(["r", "doc_id"]).take(pa.array(rows, pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), lists], ["r", "doc_id", "n", "cells"])

    numbered = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long"), "text")
    return numbered.mapInArrow(counted, "r long, doc_id long, n long, cells array<struct<term: string, tf: bigint>>")


def impact(n_docs: int, n_terms: int) -> Column:
    """What ``tf`` occurrences in a document of ``n`` terms count for, before the term's weight."""
    m = f"(100L - 90L + (90L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")


def postings(held: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, r, impact) in buckets: ranges of terms and, inside a term, of documents."""
    cells = held.select("r", "n", F.inline("cells"))
    return cells.select("term", "r", impact(n_docs, n_terms).alias("impact")).repartitionByRange("term", "r").sortWithinPartitions("term", "r")


def weight(n_docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")


def _near(asked: DataFrame, rows: int) -> DataFrame:
    """Items to be joined: dealt to all tasks if they are few, which has been counted."""
    return F.broadcast(asked) if rows <= ITEM_ROWS else asked


def _summed(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, r, score) of the matches of ``asked`` (item, term, w)."""
    return posted.join(asked, "term").groupBy("item", "r").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, seed_matches: int = SEED_MATCHES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of every item (item_id, text).

    ``seed_matches`` changes how much is joined, never the result.
    """
    asked = materialize(item_terms(items))
    n_asked = asked.count()
    # only terms that an item asks for are posted: by the scan if these are few, by a join if not
    wanted = frozenset(r.term.encode() for r in asked.select("term").distinct().toLocalIterator()) if n_asked <= ITEM_ROWS else None
    held = materialize(document_terms(docs, wanted))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    posted = postings(held, n_docs, n_terms)
    posted = materialize(posted if wanted is not None else posted.join(asked.select("term").distinct(), "term", "left_semi"))
    stats = posted.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    # ids may be null, which joins don't match
    named = asked.select(F.struct(F.col("item_id").isNull().alias("unnamed"), F.coalesce("item_id", F.lit(0)).alias("id")).alias("item"), "term")
    weighed = named.join(stats, "term").withColumn("w", weight(n_docs)).filter("w > 0")
    of_item = Window.partitionBy("item")
    rarest = of_item.orderBy(F.col("w").desc(), "term")
    weighed = materialize(weighed.withColumns({"before": F.sum("df").over(rarest) - F.col("df"), "place": F.row_number().over(rarest), "most": F.col("w") * F.col("most")}))
    seeds = weighed.filter((F.col("place") == 1) | (F.col("before") + F.col("df") <= seed_matches)).select("item", "term", "w")
    best = F.row_number().over(of_item.orderBy(F.col("score").desc()))
    first = _summed(posted, _near(seeds, n_asked)).withColumn("place", best).filter(F.col("place") <= k)
    bounds = first.filter(F.col("place") == k).select("item", F.col("score").alias("bound"))
    reach = F.sum("most").over(of_item.orderBy("most", "term"))
    split = weighed.withColumn("reach", reach).join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    split = materialize(split.select("item", "term", "w", "most", "bound", (F.col("reach") < F.col("bound")).alias("light")))
    main, light = split.filter(~F.col("light")), split.filter("light")
    room = split.groupBy("item").agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(F.col("light"), F.col("most"))), F.lit(0)).alias("room"))
    partial = materialize(_summed(posted, _near(main.select("item", "term", "w"), n_asked)).join(_near(room, n_asked), "item").filter(F.col("score") + F.col("room") >= F.col("bound")))
    higher = partial.withColumn("place", best).filter(F.col("place") == k).select("item", F.col("score").alias("higher"))
    alive = partial.join(_near(higher, n_asked), "item", "left").filter(F.col("score") + F.col("room") >= F.coalesce("higher", "bound"))
    alive = materialize(alive.select("item", "r", "score"))
    # the light terms of these documents, from the documents' own cells
    cells = held.join(alive.select("item", "r"), "r").select("item", "r", "n", F.inline("cells"))
    more = cells.join(_near(light.select("item", "term", "w"), n_asked), ["item", "term"]).select("item", "r", (F.col("w") * impact(n_docs, n_terms)).alias("score"))
    total = alive.unionAll(more).groupBy("item", "r").agg(F.sum("score").alias("score")).filter("score > 0")
    placed = total.join(held.select("r", "doc_id"), "r").withColumn("rank", F.row_number().over(of_item.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "r")))
    return placed.filter(F.col("rank") <= k).select(F.when(~F.col("item.unnamed"), F.col("item.id")).alias("item_id"), "rank", "doc_id", "score")


ORACLE = rf"""WITH lowered AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents),
sized AS (SELECT r, doc_id, len(ts) AS n, ts FROM lowered WHERE len(ts) > 0),
whole AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
post AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM post GROUP BY term), whole),
matched AS (SELECT item_id, r, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // nt)))) AS s
  FROM asked JOIN post USING (term) JOIN weights USING (term), whole),
total AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM matched GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM total) WHERE rank <= 10"""
