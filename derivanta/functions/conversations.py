"""Conversations of an evaluation as text and as message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prompts import system_prompt

#: The texts of the conversation format.
TASK = """\
Simplify the expression above step by step. Use this exact format for every step:

Step N: <full expression before> = <full expression after>    [by <rule name>]

where N is the sequential step number, each step rewrites the full expression (not just the changed subpart), and <rule name> is the rule you applied (e.g. "⊕ table", "definition of ⊗", or a transformation name).

Continue producing steps until the expression is a single symbol. Then, on its own line, state:

Final Output: <single symbol>"""
TURN_2 = ["Please continue.", "Please continue. Double-check any step you're unsure about."]
WORK = "=== WORK SO FAR ===\nYou have already produced the following partial working out."
NEXT = "=== NEXT MESSAGE ==="
METADATA = ["example_id", "base_id", "split", "difficulty", "error_type", "chain_length_x", "prefill_error_step", "target_step_count"]


def turn_2(level: Column) -> Column:
    """The second user message of a level, 0 or 1; any other level fails the job."""
    bad = F.raise_error(F.concat(F.lit("unknown level "), F.coalesce(level.cast("string"), F.lit("null")), F.lit(", expected 0 or 1"))).cast("string")
    return F.when(level == 0, TURN_2[0]).when(level == 1, TURN_2[1]).otherwise(bad)


def turn_1_user(system: Column, expression: Column) -> Column:
    """Rules, the expression as text, and the task."""
    return F.concat(F.lit('Below is a formal system called "'), system["name"], F.lit('".\n\n=== RULES ===\n'), F.rtrim(system_prompt(system)), F.lit("\n\n=== EXPRESSION ===\n"), expression, F.lit(f"\n\n=== TASK ===\n{TASK}"))


def single_turn(user: Column, prefill: Column, second: Column) -> Column:
    """The three messages as one."""
    return F.concat(user, F.lit(f"\n\n{WORK}\n\n"), prefill, F.lit(f"\n\n{NEXT}\n"), second)


def messages(mode: Column, provider: Column, user: Column, prefill: Column, second: Column) -> Column:
    """An array of (role, content): three messages if prefilled, else one; the assistant's role is "model"
    for one provider."""
    role = F.when(provider == "gemini", "model").otherwise("assistant")
    one = lambda r, c: F.struct(r.alias("role"), c.alias("content"))
    asked = F.lit("user")
    return F.when(mode == "prefill", F.array(one(asked, user), one(role, prefill), one(asked, second))).when(mode == "single_turn", F.array(one(asked, single_turn(user, prefill, second))))


def shown(user: Column, prefill: Column) -> Column:
    """A conversation for reading, with the plain second message."""
    return F.concat(F.lit("=== TURN 1 USER ===\n"), user, F.lit("\n\n=== TURN 1 ASSISTANT PREFILL ===\n"), prefill, F.lit(f"\n\n=== TURN 2 USER ===\n{TURN_2[0]}"))


def metadata(records: DataFrame) -> DataFrame:
    """The columns that describe a record, as far as they exist."""
    return records.select(*[c for c in METADATA if c in records.columns])
