"""Derivations as text: infix expressions are parsed to postfix arrays and each step is checked.

A system is a struct of the schema sources.jsonl.SYSTEM, and may differ from row to row. All work is
done by higher-order functions within the row, so nothing is shuffled. In postfix arrays of
this module a transform's token ends with "(", which tells it from operators and symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line, and the form of a step line (step number, before, after).
LINE = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
STEP = r"(?iU)^\s*Step\s+(\d+)\s*:\s*(.+?)\s*=\s*(.+?)(?:\s*\[by\s+[^\]]+\])?\s*$"


def _strings() -> Column:
    return F.array().cast("array<string>")


def system_table(system: Column) -> Column:
    """"sign,lhs,rhs" or "transform(,x" -> symbol, derived operators included: compose_left is
    (x o y) o x, double_left (x o x) o y, inv_compose t(x o y). Any other template has null results."""
    signs, moves, symbols = system["base_operations"], system["transformations"], system["symbols"]
    base = F.transform(signs, lambda o: F.transform(F.map_entries(o["table"]), lambda e: F.struct(F.concat_ws(",", o["symbol_id"], e["key"]).alias("k"), e["value"].alias("v"))))
    moved = F.transform(moves, lambda t: F.transform(F.map_entries(t["mapping"]), lambda e: F.struct(F.concat(t["name"], F.lit("(,"), e["key"]).alias("k"), e["value"].alias("v"))))

    def derived(d: Column) -> Column:
        table = F.get(F.filter(signs, lambda o: o["name"] == F.get(d["base_ops"], F.lit(0))), F.lit(0))["table"]
        mapping = F.get(F.filter(moves, lambda t: t["name"] == d["transform_name"]), F.lit(0))["mapping"]
        at = lambda x, y: F.try_element_at(table, F.concat_ws(",", x, y))
        value = lambda x, y: (
            F.when(d["template_id"] == "compose_left", at(at(x, y), x)).when(d["template_id"] == "double_left", at(at(x, x), y)).when(d["template_id"] == "inv_compose", F.try_element_at(mapping, at(x, y)))
        )
        return F.flatten(F.transform(symbols, lambda x: F.transform(symbols, lambda y: F.struct(F.concat_ws(",", d["symbol_id"], x, y).alias("k"), value(x, y).alias("v")))))

    entry = "array<struct<k:string,v:string>>"
    parts = [F.flatten(base), F.flatten(moved), F.flatten(F.transform(system["derived_operations"], derived))]
    return F.map_from_entries(F.concat(*[F.coalesce(p.cast(entry), F.array().cast(entry)) for p in parts]))


def operators(system: Column) -> Column:
    """Signs of base and derived operators."""
    both = [F.coalesce(F.transform(system[k], lambda o: o["symbol_id"]), _strings()) for k in ("base_operations", "derived_operations")]
    return F.concat(*both)


def token_pattern(system: Column) -> Column:
    """A pattern that cuts an expression: transforms with their bracket, then signs and symbols, the longest
    first, brackets, and any other character but white space (no token of the grammar)."""
    quoted = lambda names, end: F.transform(names, lambda s: F.concat(F.lit("\\Q"), s, F.lit("\\E" + end)))
    longest = lambda names: F.array_sort(names, lambda a, b: F.char_length(b) - F.char_length(a))
    moves = F.coalesce(F.transform(system["transformations"], lambda t: t["name"]), _strings())
    names = F.array_union(operators(system), system["symbols"])
    return F.concat(F.lit("(?U)"), F.array_join(F.concat(quoted(longest(moves), "\\("), quoted(longest(names), ""), F.array(F.lit("\\S"))), "|"))


def to_postfix(text: Column, pattern: Column, signs: Column, symbols: Column) -> Column:
    """Postfix tokens of "(l sign r)", "t(e)" or a symbol; null if the text is none of these as a whole.

    The fold keeps the open brackets: "(" before its sign is read, the sign after it, or a
    transform. want says that an operand must follow.
    """
    start = F.struct(_strings().alias("out"), _strings().alias("stack"), F.lit(True).alias("want"), F.lit(True).alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        out, stack, want = acc["out"], acc["stack"], acc["want"]
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        opens = want & t.endswith("(")
        operand = want & F.array_contains(symbols, t) & ~opens
        turns = ~want & F.array_contains(signs, t) & (top == "(")
        closes = ~want & (t == ")") & ~top.isin("", "(")
        return F.struct(
            F.when(operand, F.concat(out, F.array(t))).when(closes, F.concat(out, F.array(top))).otherwise(out).alias("out"),
            F.when(opens, F.concat(stack, F.array(t))).when(turns, F.concat(below, F.array(t))).when(closes, below).otherwise(stack).alias("stack"),
            (opens | turns).alias("want"),
            (acc["ok"] & (opens | operand | turns | closes)).alias("ok"),
        )

    done = lambda acc: F.when(acc["ok"] & ~acc["want"] & (F.size(acc["stack"]) == 0), acc["out"])
    return F.aggregate(F.regexp_extract_all(text, pattern, F.lit(0)), start, step, done)


def postfix_value(rpn: Column, table: Column, signs: Column) -> Column:
    """The value of to_postfix's tokens by system_table; null if a lookup fails."""

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        x, y = F.get(stack, n - 2), F.get(stack, n - 1)
        under = lambda k: F.slice(stack, F.lit(1), F.greatest(n - k, F.lit(0)))
        one, two = (F.try_element_at(table, F.concat_ws(",", t, *args)) for args in ([y], [x, y]))
        return F.when(t.endswith("("), F.concat(under(1), F.array(one))).when(F.array_contains(signs, t), F.concat(under(2), F.array(two))).otherwise(F.concat(stack, F.array(t)))

    return F.aggregate(rpn, _strings(), step, lambda stack: F.get(stack, F.lit(0)))


def compiled(system: Column) -> Column:
    """What validate needs of a system: table, signs, cut (the pattern that cuts expressions) and symbols. Where all
    rows have one system, it need not be worked out in each: see validate."""
    return F.struct(system_table(system).alias("table"), operators(system).alias("signs"), token_pattern(system).alias("cut"), system["symbols"].alias("symbols"))


def validate(rows: DataFrame, system: Column | None, text: str = "raw_continuation_text", truth: str = "ground_truth_final_output", ready: Column | None = None) -> DataFrame:
    """The rows with a struct verdict: parseable, derivation_valid, terminal_matches_gt, first_invalid_step,
    first_discontinuity_step, parsed_step_count, reason (null if the derivation ends in a symbol).

    Step lines begin with "Step n:"; other lines and a "[by ...]" at the end are ignored. The first
    check that fails decides: all step lines parse (and there is one); both sides of each step
    have one value; each step begins as the one before ended; the last ends in the true
    symbol. A null text or system is unparseable, a null truth matches nothing; step numbers
    over 19 digits give null. Columns of any name may occur; one named verdict is replaced. ready: compiled(system)
    in place of the system, as a scalar subquery where all rows have the same.
    """
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in rows.columns))  # begins no column's name
    part = lambda s, k: F.regexp_extract(s, STEP, k)
    if ready is None:
        d = rows.withColumn(f"{own}s", system).withColumn(f"{own}s", compiled(F.col(f"{own}s")))
    else:
        d = rows.withColumn(f"{own}s", ready)
    d = d.withColumn(f"{own}lines", F.filter(F.split(text, LINE, -1), lambda s: s.rlike(STEP)))
    read = lambda s: to_postfix(s, F.col(f"{own}s.cut"), F.col(f"{own}s.signs"), F.col(f"{own}s.symbols"))
    d = d.withColumn(f"{own}steps", F.transform(f"{own}lines", lambda s: F.struct(part(s, 1).try_cast("bigint").alias("n"), read(part(s, 2)).alias("before"), read(part(s, 3)).alias("after"))))
    value = lambda e: postfix_value(e, F.col(f"{own}s.table"), F.col(f"{own}s.signs"))
    d = d.withColumn(f"{own}bad", F.get(F.filter(f"{own}steps", lambda s: ~F.coalesce(value(s["before"]) == value(s["after"]), F.lit(False))), F.lit(0)))
    breaks = F.transform(f"{own}steps", lambda s, i: F.struct(s["n"].alias("n"), ((i > 0) & (F.get(F.col(f"{own}steps"), i - 1)["after"] != s["before"])).alias("cut")))
    d = d.withColumn(f"{own}break", F.get(F.filter(breaks, lambda s: s["cut"]), F.lit(0)))
    count = F.coalesce(F.size(f"{own}steps"), F.lit(0))
    readable = F.coalesce((count > 0) & ~F.exists(f"{own}steps", lambda s: s["before"].isNull() | s["after"].isNull()), F.lit(False))
    right, joined = readable & F.col(f"{own}bad").isNull(), F.col(f"{own}break").isNull()
    last = F.try_element_at(f"{own}steps", F.lit(-1))["after"]
    symbol = F.coalesce(F.size(last) == 1, F.lit(False))
    verdict = F.struct(
        readable.alias("parseable"),
        (right & joined).alias("derivation_valid"),
        (right & joined & symbol & F.coalesce(F.get(last, F.lit(0)) == F.col(truth), F.lit(False))).alias("terminal_matches_gt"),
        F.when(readable, F.col(f"{own}bad.n")).alias("first_invalid_step"),
        F.when(right, F.col(f"{own}break.n")).alias("first_discontinuity_step"),
        F.when(readable, count).otherwise(0).cast("long").alias("parsed_step_count"),
        F.when(~readable, "unparseable").when(~right, "wrong step").when(~joined, "discontinuity").when(~symbol, "terminal is not a single symbol").alias("reason"),
    )
    return d.withColumn("verdict", verdict).drop(f"{own}s", f"{own}lines", f"{own}steps", f"{own}bad", f"{own}break")
