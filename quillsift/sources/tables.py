"""Sources and sinks: text as positioned words, images, labelled profiles, the capture vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = ("png", "jpg", "jpeg", "webp")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that a task makes texts of, at most, where a table's rows are small and few but much is made of each; fixed.
SPREAD = 4000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to tasks of about ``SPREAD`` rows, and to all cores if there are fewer.

    A table of narrow rows is read by one task or a few, whatever is made of it then.
    """
    return df.repartition(shares(df), key)


def shares(df: DataFrame) -> int:
    """How many tasks ``spread`` deals rows to."""
    n = df.count()
    return max(-(-n // SPREAD), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 250)), 1)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with the verdict of ``invalid_reason``."""
    found = spark.read.format("binaryFile").load(path)
    return found.withColumn("error", invalid_reason(F.col("path"), F.col("length"))).withColumn("valid", F.col("error").isNull())


def invalid_reason(name: Column, size: Column, mime: Column | None = None) -> Column:
    """The first reason to reject an input, or null: nothing, empty, too large, extension, media type."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    reason = F.when(name.isNull() | size.isNull(), "missing").when(size <= 0, "empty").when(size > MAX_BYTES, "too large")
    reason = reason.when(~extension.isin(*EXTENSIONS), "extension")
    if mime is not None:
        reason = reason.when((mime != "") & ~mime.isin("image/png", "image/jpeg", "image/webp"), "media type")
    return reason


# What text may be read in, and what is fallen back to.
LANGUAGES, DEFAULT_LANGUAGE, FALLBACK = ("eng", "hin", "eng+hin"), "eng+hin", "eng"


def select_language(wanted: Column, available: Column) -> Column:
    """The language to read in: the one wanted if all its parts are at hand (an array), else the fallback; an error without that."""
    wanted = F.coalesce(wanted, F.lit(DEFAULT_LANGUAGE))
    held = F.size(F.array_except(F.split(wanted, r"\+"), available)) == 0
    error = F.raise_error(F.lit("no language to read the text in"))
    return F.when(wanted.isin(*LANGUAGES) & held, wanted).when(F.array_contains(available, FALLBACK), FALLBACK).otherwise(error)


def scanned_words(cells: DataFrame, scale: Column, width: Column, height: Column) -> DataFrame:
    """Words as a text reader gives them (word, confidence, x0..y1): trimmed, none empty, scaled back, kept in the frame, confidence from 0 to 1."""
    inside = lambda c, top: F.least(F.greatest(F.floor(F.col(c) / scale + 0.5), F.lit(0)), top).cast("double").alias(c)
    sure = F.when(F.coalesce("confidence", F.lit(0)) == 0, F.lit(80)).otherwise(F.col("confidence")) / 100
    kept = [c for c in cells.columns if c not in ("word", "confidence", "x0", "y0", "x1", "y1")]
    out = cells.withColumn("word", F.trim("word")).filter(F.col("word") != "")
    return out.select(*kept, "word", sure.alias("confidence"), inside("x0", width), inside("y0", height), inside("x1", width), inside("y1", height))


def first_source(**given: Column) -> Column:
    """Where an image comes from: the first of file, blob and data URL that is there; an error if none is."""
    order = [F.when(given[k].isNotNull() & (F.length(given[k]) > 0), F.struct(F.lit(k).alias("kind"), given[k].cast("binary").alias("body"))) for k in ("file", "blob", "dataUrl") if k in given]
    return F.coalesce(*order, F.raise_error(F.lit("no image is given")).cast("struct<kind: string, body: binary>"))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ln, line, ws): the lines of each text with their words. Blank lines keep their number; a null text has none."""
    cut = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("ln", "line"))
    return cut.select("doc_id", F.col("ln").cast("long").alias("ln"), "line", F.filter(F.split("line", r"\s+"), lambda w: w != "").alias("ws"))


def words(lined: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ln, wi, word) of lines, with the line's columns named in ``keep``."""
    out = lined.select("doc_id", "ln", *keep, F.posexplode("ws").alias("wi", "word"))
    return out.withColumn("wi", F.col("wi").cast("long"))


#: Cells of a line that are placed together; a line's running offsets are kept by such runs.
RUN = 256


_WORD = "trim(TRAILING ' \t\n\x0b\f\r' FROM c)"
_AT = "length(array_join(slice({}, 1, k), ''))"
_CELLS = f"""filter(CASE WHEN size(_parts) <= {RUN} THEN transform(_parts, (c, k) -> named_struct('at', cast({_AT.format("_parts")} AS bigint), 'word', {_WORD}))
  ELSE flatten(aggregate(
  transform(sequence(0, (size(_parts) - 1) div {RUN}), r -> slice(_parts, r * {RUN} + 1, {RUN})),
  named_struct('at', 0L, 'out', cast(array() AS array<array<struct<at: bigint, word: string>>>)),
  (a, run) -> named_struct('at', a.at + length(array_join(run, '')), 'out', array_append(a.out, transform(run, (c, k) ->
    named_struct('at', a.at + {_AT.format("run")}, 'word', {_WORD}))))
).out) END, c -> c.word <> '')"""


def with_cells(lined: DataFrame) -> DataFrame:
    """Add ``cells``, the words of each line with their offsets (at, word).

    Offsets are running sums inside the line, made of the line alone, so that nothing
    is shuffled.
    """
    cut = lined.selectExpr("*", r"split(line, r'(?<=\s)(?=\S)') AS _parts")
    return cut.withColumn("cells", F.expr(_CELLS)).drop("_parts")


#: Pixels of the synthetic boxes: a character's width, a line's pitch, a word's height; fixed values.
CHAR, PITCH, HEIGHT = 8.0, 20.0, 12


def word_boxes(lined: DataFrame) -> DataFrame:
    """Words with synthetic boxes: 8 by 12 pixels a character, 20 pixels a line."""
    # outer, as a plain one would have Spark make the cells once more, to leave out lines without any
    found = with_cells(lined).select("doc_id", "ln", F.posexplode_outer("cells").alias("wi", "c")).filter("wi IS NOT NULL")
    return found.select(
        "doc_id", "ln", F.col("wi").cast("long").alias("wi"), "c.word", (CHAR * F.col("c.at")).alias("x0"), (PITCH * F.col("ln")).alias("y0"),
        (CHAR * (F.col("c.at") + F.length("c.word"))).alias("x1"), (PITCH * F.col("ln") + HEIGHT).alias("y1"),
    )


PROFILE = """SELECT c_custkey AS doc_id, concat_ws({NL},
  concat('Customer ID: CUS', lpad(CAST(c_custkey AS {S}),6,'0')),
  concat('Name : ', CASE c_custkey % 5 WHEN 0 THEN 'ASHA' WHEN 1 THEN 'RAVI' WHEN 2 THEN 'MEERA' WHEN 3 THEN 'JOHN' ELSE 'LENA' END, ' ', CASE c_custkey % 4 WHEN 0 THEN 'SHARMA' WHEN 1 THEN 'SAHU' WHEN 2 THEN 'VERMA' ELSE 'SMITH' END),
  concat('Email : ', lower(CASE c_custkey % 5 WHEN 0 THEN 'ASHA' WHEN 1 THEN 'RAVI' WHEN 2 THEN 'MEERA' WHEN 3 THEN 'JOHN' ELSE 'LENA' END), '.', CAST(c_custkey AS {S}), '@example.com'),
  concat('Phone : +91 9', lpad(CAST((c_custkey*7919) % 1000000000 AS {S}),9,'0')),
  concat('Address : ', CAST(c_custkey % 90 + 1 AS {S}), ' MG Road, Bhopal - ', CAST(400000 + c_custkey % 99999 AS {S})),
  concat('Account No. : 1', lpad(CAST((c_custkey*104729) % 100000000000 AS {S}),11,'0')),
  concat('PAN : ABCDE', lpad(CAST(c_custkey % 10000 AS {S}),4,'0'), 'F'),
  concat('IFSC : SBIN0', lpad(CAST(c_custkey % 1000000 AS {S}),6,'0')),
  concat('GSTIN : 23ABCDE', lpad(CAST(c_custkey % 10000 AS {S}),4,'0'), 'F1Z5'),
  concat('Aadhaar : 2', lpad(CAST(c_custkey % 1000 AS {S}),3,'0'), ' ', lpad(CAST((c_custkey*31) % 10000 AS {S}),4,'0'), ' ', lpad(CAST((c_custkey*17) % 10000 AS {S}),4,'0')),
  concat('Roll No : ', lpad(CAST(24000000 + c_custkey AS {S}),8,'0')),
  concat('Registration : AB12/', lpad(CAST(c_custkey AS {S}),6,'0')),
  concat('Centre : ', lpad(CAST(c_custkey % 100000 + 100000 AS {S}),6,'0')),
  concat('This is to certify that ', CASE c_custkey % 3 WHEN 0 THEN 'RAVI SAHU' WHEN 1 THEN 'Meera Verma' ELSE 'LENA MARIA SMITH' END, ' has passed'),
  concat('Card : ', CASE c_custkey % 2 WHEN 0 THEN '4111111111111111' ELSE '4111111111111112' END),
  'API Token : eyJhbGciOiJIUzI1NiJ9.demo123'
) AS text FROM {T}"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled profile text for each customer, the carrier of the field detectors."""
    made = PROFILE.replace("{S}", "STRING").replace("{NL}", "char(10)").replace("{T}", "{t}")
    return spark.sql(made, t=spread(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"))


def append_vault(captures: DataFrame, path: str) -> None:
    """Append captures; what isn't said to be unsanitized counts as sanitized."""
    day = F.to_date("created_at")
    captures.withColumn("sanitized", F.coalesce("sanitized", F.lit(True))).withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def export_vault(captures: DataFrame) -> DataFrame:
    """Captures that have an image after redaction, oldest first."""
    return captures.filter(F.col("after_image").isNotNull()).orderBy("created_at", "id")


def write_redacted(result: DataFrame, path: str, on_error: str = "drop") -> None:
    """Write redacted rows; rows that failed are dropped, or kept raw if ``on_error`` is ``raw``."""
    if on_error not in ("drop", "raw"):
        raise ValueError("on_error is drop or raw")
    (result.filter("sanitized") if on_error == "drop" else result).write.mode("append").parquet(path)
