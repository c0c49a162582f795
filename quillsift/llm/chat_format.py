r"""Chat formatting by schema fingerprints.

A record's layout is fingerprinted by hashing its sorted nested field paths. The
fingerprint selects a declarative mapping, from which Spark column expressions
are built that turn the record into canonical turns: prompt and completion
pairs, instructions with optional inputs, lists of messages under several names,
and tables with a row for each turn, whose turns and roles are canonical already
and stay as they are. In a table of several layouts each record has a fingerprint of its
own, of the nested paths that hold something in it, and all are converted in one
scan. Layouts without a mapping raise an error that names the paths, or are counted
by their paths.

The template marks every turn and escapes control strings inside texts::

    <|turn|>role\\ntext<|end|>\\n

A backslash in a text is doubled, and each control string gets one backslash
after its first character, so that no control string is left in a text and the
original is read back exactly; a line feed in a role is written ``\n``. The loss mask covers the escaped texts of
assistant turns.

Defined results: a null text or role is empty; turns come in the order of turn
(null first), then role, then text, so that ties have one result; repeated rows
are repeated turns; a conversation without rows has no output. Columns beyond a
mapping's paths are ignored. Conversations of any length are streamed, turn by turn;
a turn is held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import small_batches

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common public chat templates, fixed values.
CONTROLS = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
ASSISTANT = "assistant"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted paths of all leaves; ``[]`` marks the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layout paths and how turns are made of them: either pairs of (role, field or
#: fields, joined by a blank line), or ("each", array, role field, text field), or
#: ("rows", turn field, role field, text field) where every row is a turn.
LAYOUTS: tuple[tuple[tuple[str, ...], tuple], ...] = (
    (("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    (("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    (("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
    (("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    (("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    (("input", "instruction", "output", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    (("messages[].content", "messages[].role"), ("each", "messages", "role", "content")),
    (("messages[].role", "messages[].text"), ("each", "messages", "role", "text")),
    (("conversations[].from", "conversations[].value"), ("each", "conversations", "from", "value")),
    (("role", "text", "turn"), ("rows", "turn", "role", "text")),
)
MAPPINGS = {fingerprint(list(paths)): mapping for paths, mapping in LAYOUTS}
#: Columns that some layout has; a query may ignore all others.
COLUMNS = frozenset(re.split(r"[.\[]", p)[0] for paths, _ in LAYOUTS for p in paths)


def mapping_of(schema: T.StructType, ignore: tuple[str, ...] = ()) -> tuple:
    """The mapping for the layout's fingerprint; extra columns are tried away only if named in ``ignore``."""
    paths = [p for p in field_paths(schema) if re.split(r"[.\[]", p)[0] not in ignore]
    try:
        return MAPPINGS[fingerprint(paths)]
    except KeyError:
        raise ValueError(f"no mapping for the layout {paths}") from None


def _turns(mapping: tuple) -> Column:
    """The turns that a mapping makes of a record, as an array of (turn, role, text)."""
    turn = lambda at, role, text: F.struct(at.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if mapping[0] == "rows":
        return F.array(turn(*(F.col(c) for c in mapping[1:])))
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    if mapping[0] == "each":
        _, array, role, text = mapping
        plain = lambda m: F.lower(F.coalesce(m[role], F.lit("")))
        return F.transform(array, lambda m, i: turn(i, F.coalesce(known[plain(m)], plain(m)), m[text]))

    def joined(fields: tuple[str, ...]) -> Column:
        return F.array_join(F.filter(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields)), lambda x: x != ""), "\n\n")

    return F.filter(F.array(*(turn(F.lit(i), F.lit(role), joined(fields)) for i, (role, fields) in enumerate(mapping))), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(records: DataFrame, id_col: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, turn, role, text) of records of one layout. Optional empty fields make no turn of their own."""
    return records.select(F.col(id_col).alias("conv_id"), F.inline(_turns(mapping_of(records.drop(id_col).schema, ignore))))


def _present(kind: T.DataType, at: str, value: Callable[[], Column]) -> list[tuple[str, Column]]:
    """Each path of a column, and whether a record has something there. Of an array, some element must, or it has none."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _present(f.dataType, f"{at}.{f.name}", lambda f=f: value()[f.name])]
    if isinstance(kind, T.ArrayType):
        paths = field_paths(kind.elementType, f"{at}[]")

        def some(path: str) -> Column:
            held = lambda e: dict(_present(kind.elementType, f"{at}[]", lambda: e))[path]
            return value().isNotNull() & ((F.size(value()) == 0) | F.exists(value(), held))

        return [(p, some(p)) for p in paths]
    return [(at, value().isNotNull())]


def record_turns(records: DataFrame, id_col: str, ignore: tuple[str, ...] = (), default: tuple[str, ...] | None = None) -> DataFrame:
    """(conv_id, turns, paths, fingerprint) of each record, by its own layout, in one scan; turns is null where no mapping is known.

    A record's own paths are those that hold something in it, nested ones too. Of
    records that have no path beyond those in ``default``, and no other layout, that
    is the layout: their fields may all be null.
    """
    fields = [f for f in records.drop(id_col).schema.fields if f.name not in ignore]
    present = sorted((x for f in fields for x in _present(f.dataType, f.name, lambda f=f: F.col(f.name))), key=lambda x: x[0])
    own = F.filter(F.array(*(F.when(c, F.lit(p)) for p, c in present)), lambda p: p.isNotNull()) if present else F.array().cast("array<string>")
    named = records.withColumn("_paths", own).withColumn("_print", F.substring(F.sha2(F.array_join("_paths", "\n"), 256), 1, 16))
    every = {p for p, _ in present}
    made = F.lit(None).cast("array<struct<turn: bigint, role: string, text: string>>")
    if default and set(default) <= every:
        made = F.when(F.size(F.array_except("_paths", F.array(*map(F.lit, default)))) == 0, _turns(MAPPINGS[fingerprint(list(default))]))
    for paths, mapping in LAYOUTS:
        if set(paths) <= every:
            made = F.when(F.col("_print") == fingerprint(list(paths)), _turns(mapping)).otherwise(made)
    return named.select(F.col(id_col).alias("conv_id"), made.alias("turns"), F.col("_paths").alias("paths"), F.col("_print").alias("fingerprint"))


def mixed_turns(records: DataFrame, id_col: str, ignore: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Canonical turns of a table that holds records of several layouts, and the layouts that no mapping is known for.

    The second table is (fingerprint, paths, n).
    """
    found = record_turns(records, id_col, ignore)
    unknown = found.filter(F.col("turns").isNull()).groupBy("fingerprint").agg(F.first("paths").alias("paths"), F.count("*").alias("n"))
    return found.select("conv_id", F.inline("turns")), unknown


def all_turns(records: DataFrame, id_col: str, default: tuple[str, ...] | None = None) -> DataFrame:
    """Canonical turns of a table of any known layouts; a record of another is an error that names its paths. Columns that no layout has are ignored."""
    ignore = tuple(c for c in records.columns if c not in COLUMNS)
    if default is None:
        here = {p for f in records.drop(id_col).schema.fields if f.name not in ignore for p in field_paths(T.StructType([f]))}
        if not any(set(paths) <= here for paths, _ in LAYOUTS):
            raise ValueError(f"no mapping for the layout {sorted(here)}")
    found = record_turns(records, id_col, ignore, default)
    unknown = F.raise_error(F.concat(F.lit("no mapping for the layout "), F.array_join("paths", ", ")))
    return found.select("conv_id", F.inline(F.coalesce("turns", unknown.cast("array<struct<turn: bigint, role: string, text: string>>"))))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escape_role(role: Column) -> Column:
    """A role stands on a line of its own, so that its line feeds are escaped too; no control string has an n there."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: DataFrame) -> DataFrame:
    """Add ``segment`` (the formatted turn) and the loss span in it, loss_from and loss_to (equal: none)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(TURN), escape_role(role), F.lit("\n"))
    masked = F.when(role == ASSISTANT, F.length(escape(text))).otherwise(F.lit(0))
    return turns.withColumns({
        "segment": F.concat(head, escape(text), F.lit(END + "\n")),
        "loss_from": F.length(head).cast("long"), "loss_to": (F.length(head) + masked).cast("long"),
    })


_SEGMENT = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _SEGMENT.finditer(formatted)]


def read_back(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Format conversations, read the output back and digest it: a row each.

    A conversation is streamed in the order of its turns through running
    digests; no task holds more than a batch of it.
    """
    spark = turns.sparkSession
    small_batches(spark)
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    cols = render(turns.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "text", "segment", "loss_from", "loss_to")
    dealt = cols.repartition(*([partitions] if partitions else []), "conv_id").sortWithinPartitions(*by).drop("turn", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None  # (conv_id,) and the running digests

        def row():
            return (at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for pdf in batches:
            done = []
            for conv, segment, lo, hi in zip(pdf["conv_id"], pdf["segment"], pdf["loss_from"], pdf["loss_to"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if at != (conv,):
                    if at:
                        done.append(row())
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[lo:hi])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if at:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    return dealt.mapInPandas(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(END) + 2} + length(replace({_sql_escape('role')}, chr(10), '\\n')) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
