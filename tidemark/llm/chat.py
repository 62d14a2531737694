"""Chat formatting: a finite-state machine over roles, and a declarative template, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of roles in headers, whether a role's text is learned from, and the turns that may follow each state.
TEMPLATE = {
    "open": "### ",
    "after_role": ": ",
    "close": "</turn>",
    "between": "\n",
    "names": {"system": "System", "user": "User", "assistant": "Assistant"},
    "other": "role=",
    "learned": ("assistant",),
    "start": "start",
    "moves": {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
}


def escape(text: Column) -> Column:
    """No control string of the template is left in the result; ``unescape`` gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(text, r"#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TEMPLATE["names"].items() for x in pair])
    other = F.concat(F.lit(TEMPLATE["other"]), F.replace(escape(role), F.lit(": "), F.lit(":\\ ")))
    return F.concat(F.lit(TEMPLATE["open"]), F.coalesce(F.try_element_at(names, role), other), F.lit(TEMPLATE["after_role"]))


def _role_of(name: Column) -> Column:
    roles = F.create_map(*[F.lit(x) for k, v in TEMPLATE["names"].items() for x in (v, k)])
    return F.coalesce(F.try_element_at(roles, name), unescape(F.substring(name, len(TEMPLATE["other"]) + 1, 1 << 30)))


def _machine(roles: Column) -> Column:
    """(state, turn, bad): runs the template's moves over the roles; bad is the first turn that no move allows, or -1."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in TEMPLATE["moves"].items() for b in after])
    zero = F.struct(F.lit(TEMPLATE["start"]).alias("state"), F.lit(0).alias("turn"), F.lit(-1).alias("bad"))

    def step(acc, role):
        fine = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), role))
        return F.struct(role.alias("state"), (acc["turn"] + 1).alias("turn"), F.when((acc["bad"] < 0) & ~fine, acc["turn"]).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(roles, zero, step)


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, segments, valid, bad_turn) for each conversation.

    ``segments`` are (text, loss) in order and concatenate to ``formatted``; loss is set on the escaped texts
    of learned roles alone. Turns are ordered by turn, then role and text; null texts and roles are empty,
    null ids form one conversation. bad_turn is the first position that the role machine refuses, or -1;
    such conversations are formatted too, with valid = false, so that the caller decides.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text")).alias("t"))
    chats = turns.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    learned = lambda role: role.isin(*TEMPLATE["learned"])
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = lambda t: F.array(segment(_header(t["role"]), F.lit(False)), segment(escape(t["text"]), learned(t["role"])), segment(F.lit(TEMPLATE["close"] + TEMPLATE["between"]), F.lit(False)))
    made = chats.select("id", F.flatten(F.transform("turns", pieces)).alias("segments"), _machine(F.col("turns.role")).alias("m"))
    return made.select("id", F.array_join("segments.text", "").alias("formatted"), "segments", (F.col("m.bad") < 0).alias("valid"), F.col("m.bad").alias("bad_turn"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.split(formatted, F.lit("</turn>\n"))
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda s: F.substring(s, len(TEMPLATE["open"]) + 1, 1 << 30)
    # the first ": " ends the header, since a role has none once it is escaped
    return F.transform(turns, lambda s: F.struct(_role_of(F.substring_index(body(s), ": ", 1)).alias("role"), unescape(F.substring(body(s), F.instr(body(s), ": ") + 2, F.lit(1 << 30))).alias("text")))


def learned_text(segments: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
