"""SentencePiece encoding and decoding through a table of distinct chunks.

A text is written with a marker before it and for every blank. Where no piece of the
model holds a marker after any other character, and none but single characters a
line feed, no merge can cross from a character to a marker or to either side of a
line feed. Texts are then cut there, and each chunk has the same ids wherever it
stands:

1. chunks are counted, a batch at a time and then over all documents;
2. those that repeat most, as many as ``table_rows`` and ``table_bytes`` allow, are
   the table. The library segments each of them once;
3. the table, whose size is bounded by these two, is dealt to all tasks. Ids are
   joined back by position: a document's are those of its chunks, in order. A chunk
   outside of the table, one that is rare or longer than ``LONGEST`` characters, is
   segmented in the batch that holds it, once a batch.

Which chunks are in the table changes the work, never an id. A model whose pieces
can cross a marker is refused with an error, as the cut would change ids.

Defined results: null and empty texts have no ids and decode to an empty text.
Repeated rows stay apart. Columns ``ids`` and ``decoded`` replace any so named; all
other columns stay as they are. Texts of any length are encoded whole; a very long
one is worked through in runs of chunks. An empty table has an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillsift.llm.common import materialize, small_batches

#: Default place of the public model; the same path must exist on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks longer than this are never in the table.
LONGEST = 48
#: Bounds of the table, which every Python worker holds.
TABLE_ROWS, TABLE_BYTES = 400_000, 16 << 20
#: Characters of a text that are cut into chunks at a time.
RUN = 1 << 20
CHUNK = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_CUT = re.compile(rf"(?<=[^ {MARK}])[ {MARK}]")


@functools.cache
def processor(model: str = MODEL):
    """The library's processor of a model file, whose pieces must not cross markers or line feeds."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = [p for p in pieces if MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1)]
    probe = " a  ﬁ\t\n b "
    if crossing or sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError(f"texts of this model can't be cut at markers: {crossing[:3] or 'it normalizes them'}")
    return sp


def runs(text: str) -> Iterator[str]:
    """A text with its markers, in runs of about ``RUN`` characters that begin at a marker and end before one."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + RUN)
        end = found.start() if found else len(text)
        yield (MARK if at == 0 else "") + text[at:end].replace(" ", MARK)
        at = end


def chunks(text: str) -> Iterator[list[str]]:
    for run in runs(text):
        yield CHUNK.findall(run)


def segment(found: list[str], model: str = MODEL) -> Iterator[bytes]:
    """Ids of each chunk, four bytes an id.

    Chunks are given to the library many at a time, with line feeds between them,
    which keep them apart: nothing merges with a line feed.
    """
    sp = processor(model)
    feed = sp.encode("\n")[-1]
    begin = 0
    while begin < len(found):
        end, size = begin, 0
        while end < len(found) and size < 50_000:
            size += len(found[end])
            end += 1
        part = [c for c in found[begin:end] if c != "\n"]
        ids = np.asarray(sp.encode("\n" + "\n".join(part)), dtype="<i4")
        # the first marker is the library's own, and a feed stands before each chunk
        cuts = np.r_[np.flatnonzero(ids == feed), len(ids)].tolist()
        raw, given = ids.tobytes(), 0
        for c in found[begin:end]:
            if c == "\n":
                yield np.int32(feed).tobytes()
            else:
                yield raw[4 * cuts[given] + 4 : 4 * cuts[given + 1]]
                given += 1
        begin = end


def encode_text(text: str, known: dict[str, bytes], own: dict[str, bytes], model: str = MODEL) -> bytes:
    """Ids of a whole text, four bytes an id; what neither ``known`` nor ``own`` has is segmented and, if it is short, added to ``own``."""
    out = []
    for found in chunks(text):
        ids = list(map(known.get, found))
        holes = [k for k, v in enumerate(ids) if v is None]
        if holes:
            missing = [c for c in {found[k] for k in holes} if c not in own]
            new = dict(zip(missing, segment(missing, model), strict=True))
            for k in holes:
                c = found[k]
                ids[k] = new[c] if c in new else own[c]
            own.update((c, i) for c, i in new.items() if len(c) <= LONGEST)
        out += ids
    return b"".join(out)


def decode_ids(ids: np.ndarray, model: str = MODEL) -> str:
    """The library's decode of all ids."""
    return processor(model).decode(ids.tolist()) if len(ids) else ""


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, n): how often each chunk of up to ``LONGEST`` characters occurs in all texts."""
    small_batches(docs.sparkSession)
    most = 200_000

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            short = [(c, n) for c, n in seen.items() if len(c) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["chunk", "n"])

        for b in batches:
            for text in b.column(0):
                for found in chunks(text.as_py() or ""):
                    seen.update(found)
                    if len(seen) > most:
                        yield flush()
        yield flush()

    return docs.select("text").mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: str = MODEL, table_rows: int = TABLE_ROWS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(chunk, ids): the most frequent chunks, each segmented once, as many as the bounds allow.

    Chunks are taken down to a count that they all share or exceed, so the table
    doesn't depend on how ties are ordered.
    """
    processor(model)  # refused here, before any work
    counts = materialize(chunk_counts(docs).filter("n > 1"))
    # a count's place among eighths of powers of two: some 500 rows at most, whatever the corpus
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("chunk") + 16).alias("bytes")).orderBy(F.desc("level")).collect()
    least, rows, bytes_ = 1 << 30, 0, 0
    for s in sizes:
        rows, bytes_ = rows + s["rows"], bytes_ + s["bytes"]
        if rows > table_rows or bytes_ > table_bytes:
            break
        least = s["level"]

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(segment(b.column(0).to_pylist(), model)), pa.binary())], ["chunk", "ids"])

    return materialize(counts.filter(level >= least).select("chunk").mapInArrow(segmented, "chunk string, ids binary"))


def encode(docs: DataFrame, model: str = MODEL, table_rows: int = TABLE_ROWS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with the ids of its whole texts (array<int>) and the text that these decode to."""
    small_batches(docs.sparkSession)
    table = chunk_table(docs, model, table_rows, table_bytes)
    shared = docs.sparkSession.sparkContext.broadcast({c: bytes(i) for c, i in table.toLocalIterator()})
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            own: dict[str, bytes] = {}
            ids, ends, texts = [], [0], []
            for text in b.column("text"):
                raw = encode_text(text.as_py() or "", known, own, model)
                ids.append(raw)
                ends.append(ends[-1] + len(raw) // 4)
                texts.append(decode_ids(np.frombuffer(raw, dtype="<i4"), model))
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("rest"), lists, pa.array(texts, pa.string())], ["rest", "ids", "decoded"])

    # other columns go along in one, whatever their names
    rest = F.struct(*(f"`{c.replace('`', '``')}`" for c in kept)).alias("rest")
    given = docs.select(rest, "text")
    out = given.mapInArrow(encoded, StructType([given.schema["rest"], *StructType.fromDDL("ids array<int>, decoded string")]))
    return out.select("rest.*", "ids", "decoded")
