"""Operators on event traces: guards, sessions, retention, caches, replies, prompts, JSON repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros_of(ts: str) -> Column:
    """Microseconds of a timestamp with or without a zone; only differences are used."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def repeat_guard(trace: DataFrame, key: str, order: list[str], action: str = "action", element: str = "element_id", rejected: str | None = None) -> DataFrame:
    """Add ``repeated``: a CLICK on the element that the last executed action clicked.

    The first action's predecessor is a null element, which a null element
    equals. Rows marked ``rejected`` for another reason aren't executed; a
    rejected repeat carries its predecessor's element, so plain lag sees through it.
    """
    ran = trace if rejected is None else trace.filter(~F.coalesce(rejected, F.lit(False)))
    clicked = F.when(F.col(action) == "CLICK", F.coalesce(F.col(element).cast("string"), F.lit("\0null"))).otherwise(F.lit("\0none"))
    before = F.lag(clicked, 1, "\0null").over(Window.partitionBy(key).orderBy(*order))
    return ran.withColumn("repeated", (F.col(action) == "CLICK") & (clicked == before))


def latest(df: DataFrame, n: int, order: list[Column], key: str | None = None) -> DataFrame:
    """The newest n rows (of each key, if given); without a key, a top-n without a global sort."""
    if key is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: float, tie: str) -> DataFrame:
    """(key, session, start, stop, n): a session ends once nothing comes for the gap; at the gap itself it has ended."""
    by = Window.partitionBy(key).orderBy(ts, tie)
    micros = micros_of(ts)
    new = F.when(micros - F.lag(micros).over(by) >= F.lit(int(gap_seconds * 1e6)), 1).otherwise(0)
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(by).cast("long"))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count("*").alias("n"))


def ttl_lookup(events: DataFrame, key: str, ts: str, tie: str, write: Column, read: Column, ttl_seconds: float) -> DataFrame:
    """Reads with ``hit``: the key's last write is younger than the time to live and hasn't been read yet."""
    by = Window.partitionBy(key).orderBy(ts, tie)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.max(F.when(write, micros_of(ts))).over(before)
    n_writes = F.sum(write.cast("long")).over(before)
    marked = events.withColumns({"_w": wrote, "_n": F.coalesce(n_writes, F.lit(0)), "_write": write, "_read": read}).filter("_read")
    nth = F.row_number().over(Window.partitionBy(key, "_n").orderBy(ts, tie))
    young = micros_of(ts) - F.col("_w") < F.lit(int(ttl_seconds * 1e6))
    return marked.withColumn("hit", F.coalesce((nth == 1) & young, F.lit(False))).drop("_w", "_n", "_write", "_read")


def repair_json(text: Column) -> Column:
    """The outermost object with single quotes made double and commas before a brace dropped; null if there is none."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    fixed = F.regexp_replace(F.regexp_replace(body, "'", '"'), r",\s*\}", "}")
    return F.when(body != "", fixed)


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"```(?:json)?", ""), r"`", ""))


def step_log(steps: Column) -> tuple[Column, Column]:
    """Steps joined by arrows, and the last one that isn't blank."""
    joined = F.array_join(steps, " → ")
    parts = F.filter(F.transform(F.split(joined, "→"), lambda s: F.trim(s)), lambda s: s != "")
    return joined, F.try_element_at(parts, F.lit(-1))


def fallback_reply(log: Column, ok: Column) -> Column:
    last = F.try_element_at(F.filter(F.transform(F.split(log, "→"), lambda s: F.trim(s)), lambda s: s != ""), F.lit(-1))
    return F.coalesce(last, F.when(ok, "Done.").otherwise("Something went wrong."))


def action_point(canvas: Column, x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Where to act: a canvas takes the given point, else the element's middle, else the given point, else null."""
    given = x.isNotNull() & y.isNotNull()
    px = F.when(canvas & given, x).otherwise(F.coalesce(left + width / 2, F.when(given, x)))
    py = F.when(canvas & given, y).otherwise(F.coalesce(top + height / 2, F.when(given, y)))
    return px, py


def element_manifest(elements: DataFrame, width: float, height: float, limit: int = 50) -> DataFrame:
    """Visible elements that lie in no other visible one, numbered in order: the first ``limit`` of each frame."""
    seen = elements.filter((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < width) & (F.col("y") < height) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0))
    outer = seen.select("frame_id", F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    inside = F.expr("frame_id = _f AND id <> _id AND x >= _x AND y >= _y AND x + w <= _x + _w AND y + h <= _y + _h AND (w * h < _w * _h OR id > _id)")
    top = seen.join(outer.withColumnRenamed("frame_id", "_f"), inside, "left_anti")
    return top.withColumn("ordinal", F.row_number().over(Window.partitionBy("frame_id").orderBy("id")).cast("long")).filter(F.col("ordinal") <= limit)


def point_hit(elements: DataFrame, points: DataFrame) -> DataFrame:
    """points (frame_id, px, py, ...) with ``hit``: the topmost (last drawn) element of the frame that holds the point, or null."""
    held = F.expr("px >= x AND px < x + w AND py >= y AND py < y + h")
    met = points.withColumn("_n", F.monotonically_increasing_id()).join(elements.select("frame_id", "id", "x", "y", "w", "h"), "frame_id", "left")
    return met.groupBy("_n", *points.columns).agg(F.max(F.when(held, F.col("id"))).alias("hit")).drop("_n")


# Why an early DONE is refused.
REFUSED = {
    "confirmation": "DONE rejected: form confirmation screen not detected. The form is NOT submitted yet — scroll through the remaining questions, fill anything still empty, then click Submit.",
    "required": "DONE rejected: one or more required fields on the page are still empty or invalid. Fill them before submitting.",
}


def done_gate(action: Column, is_form: Column, confirmed: Column, unfilled: Column, reachable: Column | None = None) -> Column:
    """Why a DONE is refused, or null: an unconfirmed form, then empty required fields. A page that can't be asked is trusted."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    asked = F.lit(True) if reachable is None else yes(reachable)
    refused = F.when(yes(is_form) & ~yes(confirmed), REFUSED["confirmation"]).when(yes(unfilled), REFUSED["required"])
    return F.when((action == "DONE") & asked, refused)


def stopped_message(steps: Column) -> Column:
    """What a run says that its user has stopped."""
    return F.concat(F.array_join(F.concat(steps, F.array(F.lit("Stopped by user."))), " → "))


def file_stem(name: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def correlate(requests: DataFrame, replies: DataFrame, failures: DataFrame, key: str, timeout_us: int) -> DataFrame:
    """requests (key, id, at) with ``status``: answered, failed by the worker's next failure, timed out; and ``took`` of the answered.

    The first reply (id, at) that isn't earlier than its request answers it if it comes
    within the time; a failure (key, at) fails all requests of its worker that are still
    open then.
    """
    all_ = replies.groupBy("id").agg(F.collect_set("at").alias("_rs"))
    both = requests.select(key, "id", "at", F.lit(False).alias("_bad")).unionByName(failures.select(key, F.lit(None).cast("long").alias("id"), "at", F.lit(True).alias("_bad")))
    later = Window.partitionBy(key).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    timed = both.withColumn("_f", F.min(F.when(F.col("_bad"), F.col("at"))).over(later)).filter(~F.col("_bad")).drop("_bad")
    limit = F.col("at") + timeout_us
    met = timed.join(all_, "id", "left").withColumn("_r", F.array_min(F.filter("_rs", lambda r: r >= F.col("at"))))
    answered = (F.col("_r") < limit) & (F.col("_f").isNull() | (F.col("_r") <= F.col("_f")))
    answered = F.coalesce(answered, F.lit(False))
    failed = F.col("_f") < limit
    status = F.when(answered, "answered").when(failed, "failed").otherwise("timed out")
    return met.select(key, "id", status.alias("status"), F.when(answered, F.col("_r") - F.col("at")).alias("took"))
