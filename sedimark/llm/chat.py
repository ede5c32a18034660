"""Chat formatting: a finite-state machine over roles, a declarative template and per-segment loss flags.

Built-in DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import without


@dataclass(frozen=True)
class Template:
    """How roles look and which role's texts are learned.

    `marks` gives each known role its opening and closing; other roles use `other`, with the role's name inside.
    `moves` is the state machine: (state, role) -> next state; what it lacks leads to "invalid" for good.
    `foreign` lists control strings of other formats that texts must not carry either.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("<s> ", " </s>"),
    })
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>\n", "\n<<END>>\n")
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    final: tuple[str, ...] = ("answered",)
    foreign: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def controls(self) -> list[str]:
        own = [p.strip() for pair in self.marks.values() for p in pair] + [p.strip() for p in self.other]
        return list(dict.fromkeys([*own, *self.foreign]))


def _code(i: int) -> str:
    return "\\" + chr(ord("a") + i)


def escape(text: Column, template: Template) -> Column:
    r"""Reversible: `\` becomes `\0`, then control string i becomes `\` and a letter; no control string can remain."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for i, c in enumerate(template.controls()):
        out = F.replace(out, F.lit(c), F.lit(_code(i)))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for i, c in enumerate(template.controls()):
        out = F.replace(out, F.lit(_code(i)), F.lit(c))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def _machine(roles: Column, template: Template) -> Column:
    """State after all roles, by a fold over the transition table."""
    table = F.create_map(*[F.lit(x) for (s, r), t in template.moves.items() for x in (f"{s}\n{r}", t)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat_ws("\n", state, role)), F.lit("invalid")))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<kind,text,loss>>, formatted string, state string, valid boolean.

    Turns (conv_id, turn, role, text) are ordered by turn, then role, then text; a null turn comes last, repeated rows
    stay repeated. A null text or role is empty. A null conv_id is a conversation of its own. An invalid order of roles is
    reported in `valid`, not dropped. An empty table gives no rows; further columns are ignored. `formatted` is the
    segments' texts joined; `loss` marks the segments to learn from (learned roles' texts, without the markers).

    A conversation is one row of the result, so one task must hold its text: its size is that of the result row. Partial
    lists are combined map-side before the shuffle.
    """
    t = template or Template()
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        pre, post, known = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
        for role, (p, q) in t.marks.items():
            pre, post = F.when(x["role"] == role, p).otherwise(pre), F.when(x["role"] == role, q).otherwise(post)
        pre = F.coalesce(pre, F.concat(F.lit(t.other[0]), escape(x["role"], t), F.lit(t.other[1])))
        post = F.coalesce(post, F.lit(t.other[2]))
        mark = lambda c: F.struct(F.lit("mark").alias("kind"), c.alias("text"), F.lit(False).alias("loss"))
        body = F.struct(F.lit("text").alias("kind"), escape(x["text"], t).alias("text"), x["role"].isin(*t.learned).alias("loss"))
        return F.array(mark(pre), body, mark(post))

    state = _machine(F.transform("turns", lambda x: x["role"]), t)
    out = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("state"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*t.final).alias("valid"))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else ("\\n" if c == "\n" else "\\" + c) for c in s)


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The inverse, from `formatted` alone: adds turns array<struct<role,text>> as they were before formatting."""
    t = template or Template()
    shapes = [f"{_quoted(p)}.*?{_quoted(q)}" for p, q in t.marks.values()] + [f"{_quoted(t.other[0])}.*?{_quoted(t.other[2])}"]
    pieces = F.regexp_extract_all("formatted", F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def turn(p: Column) -> Column:
        rest = F.substring_index(F.substr(p, F.lit(len(t.other[0]) + 1)), t.other[1], 1)
        role, text = unescape(rest, t), F.substr(p, F.length(rest) + len(t.other[0]) + len(t.other[1]) + 1, F.length(p) - F.length(rest) - sum(map(len, t.other)))
        for name, (a, b) in t.marks.items():
            role = F.when(p.startswith(a), name).otherwise(role)
            text = F.when(p.startswith(a), F.substr(p, F.lit(len(a) + 1), F.length(p) - (len(a) + len(b)))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return without(formatted, ["turns"]).withColumn("turns", F.transform(pieces, turn))
