"""Chat formatting: records of any known layout become canonical turns and one training text with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
# Strings that steer chat templates. Inside texts each is broken by a backslash after its first character.
CONTROL = (OPEN, CLOSE, BREAK, "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records with the given nested fields become turns.

    ``turns`` is the path of an array with ``role`` and ``text`` fields below it; or ``fields`` lists
    (role, paths) where the texts of the paths that exist are joined by an empty line.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: bool = False  # map other spellings of roles


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), turns="messages"),
    Layout("messages-text", ("messages[].role", "messages[].text"), turns="messages", text="text"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", rename=True),
    Layout("dialog", ("dialog[].content", "dialog[].speaker"), turns="dialog", role="speaker", rename=True),
    Layout("turns", ("turns[].role", "turns[].text"), turns="turns", text="text"),
    Layout("prompt-completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system-prompt-response", ("prompt", "response", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system-prompt-completion", ("completion", "prompt", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system-instruction", ("instruction", "output", "system"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(
        "system-instruction-input", ("input", "instruction", "output", "system"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction-input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question-answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("nested-data", ("data.instruction", "data.output"), fields=(("user", ("data.instruction",)), ("assistant", ("data.output",)))),
)
# Other spellings of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def known_paths(layouts: Sequence[Layout] = LAYOUTS) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def _json_path(path: str) -> str:
    return "$." + path.replace("[]", "[*]")


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the nested field paths of the largest layout that a JSON record contains; the first listed of equally large ones.

    A path below an array exists if any of its elements has it. Absent and null fields are alike, and fields beside those
    of the layout don't count. A record that contains no layout has the hash of the known paths it has, one that is no JSON
    that of none.
    """
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    paths = known_paths(layouts)
    ordered = sorted(layouts, key=lambda x: -len(x.paths))

    def choose(there: Column) -> Column:
        out = F.xxhash64(F.array_join(there, "\n"))
        for layout in reversed(ordered):
            inside = F.lit(True)
            for p in layout.paths:
                inside = inside & F.array_contains(there, p)
            out = F.when(inside, layout_hash(layout)).otherwise(out)
        return out

    def present(names: Column) -> Column:
        found = [F.when(F.array_contains(names, re.split(r"[.\[]", p)[0]) & F.get_json_object(record, _json_path(p)).isNotNull(), F.lit(p)) for p in paths]
        return F.array_compact(F.array(*found))

    return F.get(F.transform(F.transform(F.array(keys), present), choose), F.lit(0))


def layout_hash(layout: Layout) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(layout.paths))))


def canonical_turns(record: Column, print_: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Turns of a record by the layout whose paths hash to its fingerprint; null for a record that contains none.

    Layouts that say so map other spellings of roles; a null role or text is an empty one.
    """
    out = F.lit(None).cast(TURNS)
    empty = F.lit("")

    def role_of(raw: Column, rename: bool) -> Column:
        named = F.coalesce(raw, empty)
        for other, name in ROLES.items() if rename else ():
            named = F.when(F.lower(raw) == other, F.lit(name)).otherwise(named)
        return named

    def turn_of(layout: Layout, item: Column) -> Column:
        return F.struct(role_of(item[layout.role], layout.rename).alias("role"), F.coalesce(item[layout.text], empty).alias("text"))

    for layout in reversed(layouts):
        if layout.turns:
            items = F.from_json(F.get_json_object(record, f"$.{layout.turns}"), f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
            turns = F.transform(items, partial(turn_of, layout))
        else:
            made = []
            for role, paths in layout.fields:
                texts = [F.get_json_object(record, _json_path(p)) for p in paths]
                joined = F.array_join(F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != "")), "\n\n")
                made.append(F.struct(F.lit(role).alias("role"), joined.alias("text")))
            turns = F.array(*made)
        out = F.when(print_ == layout_hash(layout), turns).otherwise(out)
    return out


def escape(text: Column) -> Column:
    """Backslashes doubled, then every control string broken by one; ``unescape`` gives the text back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role stays on one line: its line breaks become a control string of their own."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def render(turns: Column) -> Column:
    """The training text: each turn is opened with its role and closed."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE + "\n"))), ""
    )


def loss_mask(turns: Column) -> Column:
    """(start, end) code points, ends exclusive, of the assistant texts in the rendered text."""
    shell = len(OPEN) + 1 + len(CLOSE) + 1
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + len(OPEN) + 1 + t["role_chars"]
        span = F.struct(begin.cast("long").alias("start"), (begin + t["text_chars"]).cast("long").alias("end"))
        return F.struct(
            (state["at"] + shell + t["role_chars"] + t["text_chars"]).cast("long").alias("at"),
            F.when(t["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    sizes = F.transform(turns, lambda t: F.struct(
        F.length(escape_role(t["role"])).alias("role_chars"), F.length(escape(t["text"])).alias("text_chars"), (t["role"] == "assistant").alias("learn"),
    ))
    return F.aggregate(sizes, zero, step)["spans"]


def read_back(formatted: Column) -> Column:
    """Turns of a rendered text."""
    closed = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(closed, F.lit(1), F.greatest(F.size(closed) - 1, F.lit(0))), lambda s: F.substring(s, len(OPEN) + 1, F.length(s)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


# layouts of records by the roles of a conversation, in the order of their numbers
TURN_LAYOUTS = ("messages", "messages-text", "conversations", "dialog", "turns")
PAIR_LAYOUTS = ("prompt-completion", "prompt-response", "instruction", "question-answer", "nested-data")
SYSTEM_LAYOUTS = ("system-prompt-response", "system-prompt-completion", "system-instruction")


def _record_of(layout: Layout, turns: Column) -> Column:
    """A record of a layout out of turns whose roles it can hold."""
    if layout.turns:
        spelt = {"user": "human", "assistant": "gpt"} if layout.rename else {}

        def item(t: Column) -> Column:
            role = t["role"]
            for name, other in spelt.items():
                role = F.when(t["role"] == name, F.lit(other)).otherwise(role)
            return F.struct(role.alias(layout.role), t["text"].alias(layout.text))

        return F.to_json(F.struct(F.transform(turns, item).alias(layout.turns)))
    flat = [(paths[0], F.get(turns, i)["text"]) for i, (_, paths) in enumerate(layout.fields)]
    inner = F.struct(*[text.alias(path.split(".")[-1]) for path, text in flat])
    return F.to_json(F.struct(inner.alias("data")) if "." in flat[0][0] else inner)


def conversation_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", mixed: bool = False) -> DataFrame:
    """(conv, record): one JSON record for each conversation, turns in order.

    Records are in the ``messages`` layout; with ``mixed`` in any layout that can hold the conversation's roles, chosen by a
    hash of the key. Ties in ``turn`` are ordered by role and text; null texts and roles are empty. A conversation is one
    training text, so its turns have to meet in one row; rows of different conversations never do. Other columns are
    ignored, a null key is one conversation, and an empty table gives an empty result.
    """
    empty = F.lit("")
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    grouped = rows.groupBy(F.col(conv)).agg(F.array_sort(F.collect_list(part)).alias("m"))
    by_name = {layout.name: layout for layout in LAYOUTS}
    made = _record_of(by_name["messages"], F.col("m"))
    if mixed:
        roles = F.transform("m", lambda t: t["role"])

        def one_of(names: Sequence[str], otherwise: Column) -> Column:
            out = otherwise
            for i, name in enumerate(names):
                out = F.when(F.pmod(F.xxhash64(conv), len(names)) == i, _record_of(by_name[name], F.col("m"))).otherwise(out)
            return out

        usual = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
        turns = one_of(TURN_LAYOUTS, made)
        made = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.when(F.pmod(F.xxhash64(conv, F.lit("flat")), 2) == 0, one_of(PAIR_LAYOUTS, made)).otherwise(turns))
        made = made.when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), one_of(SYSTEM_LAYOUTS, turns))
        # other spellings of roles would be mapped by layouts that know them
        made = made.when(usual, turns).otherwise(_record_of(by_name["messages"], F.col("m")))
    return grouped.select(conv, made.alias("record"))


def format_records(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout_print``, ``turns``, ``formatted`` and ``loss_spans``.

    Records that contain no layout, null and broken ones keep their row with null turns, text and mask. A record without
    turns gives an empty text. An empty table gives an empty result; other columns stay, but those that have the names of
    the four new ones are replaced.
    """
    out = records.withColumn("layout_print", fingerprint(F.col(record), layouts))
    out = out.withColumn("turns", canonical_turns(F.col(record), F.col("layout_print"), layouts))
    return out.withColumn("formatted", render(F.col("turns"))).withColumn("loss_spans", loss_mask(F.col("turns")))
