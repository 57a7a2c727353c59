"""Chat formatting: layouts told apart by a fingerprint of their field paths, then one reversible template."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout ([] steps into an array), and SQL over the record's columns for its turns as array<struct<role, text>>."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _pair(user: str, reply: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {reply}))"


#: Declarative mappings; a record has a layout if, of the record's paths, those the layout names hash to its fingerprint.
#: Of several it is the one with the most paths, then the first in this list, so other fields never hide a layout.
LAYOUTS = (
    Layout("rows", ("role", "text", "turn"), "array(named_struct('role', role, 'text', text))"),
    Layout("messages", ("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", ("conversations[].from", "conversations[].value"),
           "transform(conversations, m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))"),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("instruction_input", ("input", "instruction", "output"), _pair("concat_ws('\\n', instruction, nullif(input, ''))", "output")),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("question_answer", ("answer", "question"), _pair("question", "answer")),
)


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves: a.b for structs, a[] for array elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths) -> str:
    """A hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layouts by their fingerprints, in the order in which they are tried.
BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in sorted(LAYOUTS, key=lambda x: -len(x.paths))}


def layout_of(paths) -> Layout | None:
    """The layout of a record with these field paths; None if it has none of the known ones."""
    return next((layout for key, layout in BY_FINGERPRINT.items() if fingerprint(set(layout.paths).intersection(paths)) == key), None)


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of records(conv_id, ...) in the layout that the fingerprints of their schema's paths select.

    Raises ValueError for a schema that holds no known layout; further columns, those of other layouts
    included, change nothing unless they make a layout of more paths. Rows-by-turn keep their turn
    numbers; other layouts number from 0, and a record without turns gives no row.
    """
    paths = field_paths(records.schema)
    layout = layout_of(paths)
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(paths)}")
    if layout.name == "rows":
        return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.posexplode(F.expr(layout.turns)).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


_ARRAYS = ("messages", "conversations")


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def json_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, layout) of records(conv_id, json), each in a layout of its own.

    A record's fingerprints hash its field paths (of an array, its first element's) as far as a layout names them;
    layout is null, with one row without role and text, where none fits or the JSON is bad.
    """
    json = F.col("json")
    none = F.array().cast("array<string>")
    paths = F.coalesce(F.filter(F.json_object_keys(json), lambda k: ~k.isin(*_ARRAYS)), none)
    for a in _ARRAYS:
        inner = F.json_object_keys(F.get_json_object(json, f"$.{a}[0]"))
        paths = F.concat(paths, F.coalesce(_prefixed(inner, f"{a}[]."), none))
    paths = F.array_distinct(paths)
    print_ = F.lit(None).cast("string")
    for key, layout in reversed(BY_FINGERPRINT.items()):
        own = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, layout.paths))))
        if layout.name != "rows":
            print_ = F.when(F.substring(F.sha2(F.array_join(own, "\n"), 256), 1, 16) == key, F.lit(key)).otherwise(print_)
    fields = "struct<{}>".format(", ".join([
        *(f"{p}:string" for p in sorted({p for layout in LAYOUTS for p in layout.paths}) if "[" not in p and p != "turn"),
        "messages:array<struct<role:string,content:string>>", "conversations:array<struct<from:string,value:string>>",
    ]))
    data = records.select(F.col("conv_id").cast("long").alias("conv_id"), print_.alias("print"), F.from_json(json, fields).alias("d")).select("conv_id", "print", "d.*")
    kind = "array<struct<role:string,text:string>>"
    turns, name = F.lit(None).cast(kind), F.lit(None).cast("string")
    for key, layout in BY_FINGERPRINT.items():
        if layout.name != "rows":
            turns = F.when(F.col("print") == key, F.expr(layout.turns).cast(kind)).otherwise(turns)
            name = F.when(F.col("print") == key, F.lit(layout.name)).otherwise(name)
    out = data.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


#: What opens and closes a turn, by role; other roles are named inside [ROLE].
OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": " <</SYS>>\n", "user": " [/INST]\n", "assistant": " </s>\n"}
#: Control strings; in a text each gets a backslash in front, and a backslash is doubled.
CONTROL = r"(<<SYS>>|<</SYS>>|\[/?INST\]|</?s>|\[/?ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_stop) of turns(conv_id, turn, role, text).

    A conversation's text is its turns' `formatted` in order of (turn, role, text);
    loss_start..loss_stop are the code points of the turn that the loss mask covers: the
    escaped text of an assistant, nothing (0..0) elsewhere. A row is formatted by itself, so a
    conversation of any length needs no group.

    Defined results: null text and null role are empty; a null turn comes first; repeated
    rows are turns of their own; other columns are dropped.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    named = F.col("role").isin(*OPEN)
    open_ = F.concat(F.lit("[ROLE] "), F.base64(F.encode("role", "UTF-8")), F.lit("\n"))
    close = F.lit(" [/ROLE]\n")
    for r in OPEN:
        open_ = F.when(F.col("role") == r, F.lit(OPEN[r])).otherwise(open_)
        close = F.when(F.col("role") == r, F.lit(CLOSE[r])).otherwise(close)
    body = escape(F.col("text"))
    masked = named & (F.col("role") == "assistant")
    start = F.when(masked, F.lit(len(OPEN["assistant"]))).otherwise(0).cast("long")
    return turns.withColumn("formatted", F.concat(open_, body, close)).withColumn("loss_start", start).withColumn(
        "loss_stop", F.when(masked, F.length("formatted") - len(CLOSE["assistant"])).otherwise(0).cast("long")
    )


_TURN = r"(?s)\A(?:(<<SYS>>|\[INST\]|<s>) |\[ROLE\] ([A-Za-z0-9+/=]*)\n)(.*) (?:<</SYS>>|\[/INST\]|</s>|\[/ROLE\])\n\z"


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text) read from `formatted` and its loss span alone."""
    part = lambda k: F.regexp_extract("formatted", _TURN, k)
    opened = F.create_map(*[F.lit(x) for r, o in OPEN.items() for x in (o.strip(), r)])
    role = F.coalesce(F.element_at(opened, F.nullif(part(1), F.lit(""))), F.decode(F.unbase64(part(2)), "UTF-8"))
    loss = F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    return formatted.select("conv_id", "turn", role.alias("role"), unescape(part(3)).alias("text"), unescape(loss).alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(turns: DataFrame) -> DataFrame:
    """Counts and digests of each conversation of `read_back` rows; a conversation streams through its hashes turn by turn."""
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        done, open_, last = [], None, object()

        def close():
            if open_ is not None:
                conv, n, h, chars, g, total = open_
                done.append((conv, n, h.hexdigest(), chars, g.hexdigest(), total))

        def batch():
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for part in batches:
            for conv, role, text, loss, chars in zip(*[part.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "chars")], strict=True):
                if conv != last:
                    close()
                    open_, last = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(loss)
                open_[4].update(loss.encode())
                open_[5] += chars
            if len(done) >= 5_000:
                yield batch()
                done = []
        close()
        yield batch()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _DIGEST)
