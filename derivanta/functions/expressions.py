"""Expressions as postfix arrays of integers: evaluation, reduction, corruption and rendering by folds.

A token of at least 0 is a symbol's place in the system's list; -1 - k is operator k: base operators
first, then derived ones, then transforms. compile_system() turns a system of the schema
sources.jsonl.SYSTEM into the tables that the folds read by place; a system may be one for all
rows (a scalar subquery) or one a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of the templates of derived operators: (x o y) o x, t(x o y), (x o x) o y.
TEMPLATES = ("compose_left", "inv_compose", "double_left")
_STEPS = "array<struct<rule:int,result:int,before:array<int>,after:array<int>>>"


def let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _place(items: Column, x: Column) -> Column:
    """The place of x in items, from 0; null if it is not there."""
    return F.nullif(F.array_position(items, x), F.lit(0)).cast("int") - 1


def _strings(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def compile_system(system: Column) -> Column:
    """symbols, names (of operators and transforms), signs (as shown), n, base and binary (how many
    operators), table (results by place), template, base_of and move_of (of derived operators).

    The table holds n * n results for each operator, derived ones included, by left, then
    right operand, and n for each transform. Results that are missing or no symbol are null.
    """
    symbols, ops, made, moves = (system[c] for c in ("symbols", "base_operations", "derived_operations", "transformations"))
    of = lambda items, field: _strings(F.transform(items, lambda o: o[field]))
    grid = lambda f: F.flatten(F.transform(symbols, lambda x: F.transform(symbols, lambda y: f(x, y))))
    ints = lambda x: F.coalesce(x.cast("array<int>"), F.array().cast("array<int>"))
    base_names, move_names = of(ops, "name"), of(moves, "name")
    tables = F.transform(ops, lambda o: grid(lambda x, y: _place(symbols, F.try_element_at(o["table"], F.concat_ws(",", x, y)))))
    moved = F.transform(moves, lambda t: F.transform(symbols, lambda x: _place(symbols, F.try_element_at(t["mapping"], x))))
    n = F.size(symbols)

    def derived(d: Column) -> Column:
        table = F.get(tables, _place(base_names, F.get(d["base_ops"], F.lit(0))))
        move = F.get(moved, _place(move_names, d["transform_name"]))
        at = lambda x, y: F.get(table, x * n + y)
        value = lambda x, y: F.when(d["template_id"] == TEMPLATES[0], at(at(x, y), x)).when(d["template_id"] == TEMPLATES[1], F.get(move, at(x, y))).when(d["template_id"] == TEMPLATES[2], at(at(x, x), y))
        return grid(lambda x, y: value(_place(symbols, x), _place(symbols, y)))

    return F.struct(
        symbols.alias("symbols"),
        F.concat(base_names, of(made, "name"), move_names).alias("names"),
        F.concat(of(ops, "symbol_id"), of(made, "symbol_id"), move_names).alias("signs"),
        n.alias("n"),
        F.size(base_names).alias("base"),
        (F.size(base_names) + F.size(of(made, "name"))).alias("binary"),
        F.concat(ints(F.flatten(tables)), ints(F.flatten(F.transform(made, derived))), ints(F.flatten(moved))).alias("table"),
        ints(F.transform(made, lambda d: _place(F.array(*[F.lit(t) for t in TEMPLATES]), d["template_id"]))).alias("template"),
        ints(F.transform(made, lambda d: _place(base_names, F.get(d["base_ops"], F.lit(0))))).alias("base_of"),
        ints(F.transform(made, lambda d: _place(move_names, d["transform_name"]))).alias("move_of"),
    )


def tokens(names: Column, a: Column) -> Column:
    """Postfix tokens by name -> integers; an unknown name is null."""
    return F.transform(names, lambda t: F.coalesce(_place(a["symbols"], t), -1 - _place(a["names"], t)))


def names(rpn: Column, a: Column) -> Column:
    return F.transform(rpn, lambda t: F.when(t >= 0, F.get(a["symbols"], t)).otherwise(F.get(a["names"], -1 - t)))


def _value(a: Column, k: Column, x: Column, y: Column) -> Column:
    """Of operator k, by the table: of y alone for a transform."""
    n = a["n"]
    return F.get(a["table"], F.when(k < a["binary"], (k * n + x) * n + y).otherwise((a["binary"] * n + k - a["binary"]) * n + y).cast("int"))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _evaluate_packed(rpn: Column, a: Column) -> Column:
    """The stack as the digits of one number to the base n, below a leading one: no arrays are made."""
    n = F.greatest(a["n"], F.lit(2)).cast("bigint")

    def step(stack: Column, t: Column) -> Column:
        k, below = -1 - t, _div(stack, n)
        binary = k < a["binary"]
        rest = F.when(binary, _div(below, n)).otherwise(below)
        return F.when(t >= 0, stack * n + t).when(rest >= 1, rest * n + _value(a, k, below % n, stack % n))

    return F.aggregate(rpn, F.lit(1).cast("bigint"), step, lambda s: F.when(_div(s, n) == 1, (s % n).cast("int")))


def _evaluate_stack(rpn: Column, a: Column) -> Column:
    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        apply = lambda k: F.concat(F.slice(stack, F.lit(1), F.greatest(n - F.when(k < a["binary"], 2).otherwise(1), F.lit(0))), F.array(_value(a, k, F.get(stack, n - 2), F.get(stack, n - 1))))
        return F.when(t >= 0, F.concat(stack, F.array(t))).otherwise(let(-1 - t, apply))

    return F.aggregate(rpn, F.array().cast("array<int>"), step, lambda stack: F.when(F.size(stack) == 1, F.get(stack, F.lit(0))))


def evaluate(rpn: Column, a: Column) -> Column:
    """The place of the value of a postfix expression; null if a lookup fails or the tokens are no expression.
    Expressions whose symbols, and one, fit a long number to the base n are evaluated in one."""
    return F.when((F.size(rpn) + 1) * F.log2(F.greatest(a["n"], F.lit(2)).cast("double")) < 62, _evaluate_packed(rpn, a)).otherwise(_evaluate_stack(rpn, a))


def reducible_nodes(rpn: Column) -> Column:
    return F.size(F.filter(rpn, lambda t: t < 0))


def derived_nodes(rpn: Column, a: Column) -> Column:
    return F.size(F.filter(rpn, lambda t: (-1 - t >= a["base"]) & (-1 - t < a["binary"])))


def n_steps(rpn: Column, a: Column) -> Column:
    """Steps of a full reduction: one for an operator or transform, three for a derived operator (its
    expansion, then two)."""
    return reducible_nodes(rpn) + 2 * derived_nodes(rpn, a)


def _redex(now: Column, a: Column) -> Column:
    """Of the first operator: p (its place, from 1), k, x and y (its operands), arity."""
    found = F.array_position(F.transform(now, lambda t: t < 0), True).cast("int")
    at = lambda p: F.struct(p.alias("p"), (-1 - F.get(now, p - 1)).alias("k"), F.get(now, p - 3).alias("x"), F.get(now, p - 2).alias("y"))
    return let(found, at)


def _splice(now: Column, r: Column, a: Column, new: Column) -> Column:
    """now with the first operator and its operands replaced."""
    start = r["p"] - F.when(r["k"] < a["binary"], 3).otherwise(2)
    return F.concat(F.slice(now, F.lit(1), start), new, F.slice(now, r["p"] + 1, F.size(now)))


def reduce_steps(rpn: Column, a: Column) -> Column:
    """Array of (rule, result, before, after), innermost leftmost first: in postfix order that is the first
    operator. rule is the operator's place; an expansion of a derived one has a null result. An
    expression that is a symbol has no steps."""

    def body(r: Column, d: Column) -> Column:
        base, template = (-1 - F.get(a["base_of"], d)), F.get(a["template"], d)
        x, y = r["x"], r["y"]
        return F.when(template == 0, F.array(x, y, base, x, base)).when(template == 1, F.array(x, y, base, -1 - a["binary"] - F.get(a["move_of"], d))).otherwise(F.array(x, x, base, y, base))

    def rewrite(now: Column, r: Column) -> Column:
        derived = (r["k"] >= a["base"]) & (r["k"] < a["binary"])
        row = lambda v, new: F.struct(r["k"].alias("rule"), v.alias("result"), now.alias("before"), _splice(now, r, a, new).alias("after"))
        plain = let(_value(a, r["k"], r["x"], r["y"]), lambda v: row(v, F.array(v)))
        return F.when(derived, row(F.lit(None).cast("int"), body(r, r["k"] - a["base"]))).otherwise(plain)

    def step(done: Column, _: Column) -> Column:
        now = F.coalesce(F.try_element_at(done, F.lit(-1))["after"], rpn)
        return let(now, lambda e: let(_redex(e, a), lambda r: F.concat(done, F.array(rewrite(e, r)))))

    n = n_steps(rpn, a)
    return F.when(n == 0, F.array().cast(_STEPS)).when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.array().cast(_STEPS), step))


def arity(token: Column, a: Column) -> Column:
    """Operands of a token: none for a symbol, two for an operator, one for a transform."""
    return F.when(token >= 0, 0).when(-1 - token < a["binary"], 2).otherwise(1)


def first_of(rpn: Column, place: Column, a: Column) -> Column:
    """Where the subexpression that ends at a place starts (places count from 1).

    Read from its end to the left, a subexpression needs one value; each token gives one and needs as many
    as its arity. The running sum of arity - 1 first comes to -1 at the start.
    """
    walk = lambda s, t: F.when(s["open"] == 0, s).otherwise(F.struct((s["open"] + arity(t, a) - 1).alias("open"), (s["at"] - 1).alias("at")))
    start = F.struct(F.lit(1).alias("open"), (place + 1).cast("int").alias("at"))
    return F.aggregate(F.reverse(F.slice(rpn, F.lit(1), F.greatest(place, F.lit(0)))), start, walk, lambda s: F.when(s["open"] == 0, s["at"]))


def _child(rpn: Column, place: Column, way: Column, a: Column) -> Column:
    """The place of a node's operand: the only one of a transform; of an operator the left one for way 0, else
    the right one. Null for a symbol."""
    n = arity(F.get(rpn, place - 1), a)
    return F.when((n == 2) & (way == 0), first_of(rpn, place - 1, a) - 1).when(n > 0, place - 1)


def place_at(rpn: Column, path: Column, a: Column) -> Column:
    """The place of the node that a path of ways leads to from the whole expression; null if it goes on
    below a symbol. The empty path leads to the whole."""
    down = lambda p, way: F.when(p.isNotNull(), _child(rpn, p, way, a)).cast("int")
    return F.aggregate(path, F.nullif(F.size(rpn), F.lit(0)), down)


def get_at(rpn: Column, path: Column, a: Column) -> Column:
    """The subexpression at a path; null if there is none."""
    part = lambda p: F.when(p.isNotNull(), let(first_of(rpn, p, a), lambda i: F.slice(rpn, i, p - i + 1)))
    return let(place_at(rpn, path, a), part)


def replace_at(rpn: Column, path: Column, new: Column, a: Column) -> Column:
    """rpn with the subexpression at a path replaced by another; null if there is none."""
    spliced = lambda p: F.when(p.isNotNull(), let(first_of(rpn, p, a), lambda i: F.concat(F.slice(rpn, F.lit(1), i - 1), new, F.slice(rpn, p + 1, F.size(rpn)))))
    return let(place_at(rpn, path, a), spliced)


def path_to(rpn: Column, place: Column, a: Column) -> Column:
    """The path from the whole expression to the node at a place: the inverse of place_at. A transform's
    operand is way 0. Null if there is no such place."""
    none = F.array().cast("array<int>")

    def down(s: Column, _: Column) -> Column:
        left = first_of(rpn, s["at"] - 1, a) - 1
        step = lambda at, way: F.struct(at.cast("int").alias("at"), F.concat(s["path"], F.array(way)).alias("path"))
        two = let(left, lambda x: F.when(place <= x, step(x, F.lit(0))).otherwise(step(s["at"] - 1, F.lit(1))))
        return F.when(s["at"] == place, s).when(arity(F.get(rpn, s["at"] - 1), a) == 2, two).otherwise(step(s["at"] - 1, F.lit(0)))

    start = F.struct(F.size(rpn).alias("at"), none.alias("path"))
    return F.when(place.between(1, F.size(rpn)), F.aggregate(rpn, start, down, lambda s: s["path"]))


def redex_path(rpn: Column, a: Column) -> Column:
    """The path to the subexpression that is reduced next, the innermost leftmost one; null for a symbol."""
    return path_to(rpn, F.nullif(F.array_position(F.transform(rpn, lambda t: t < 0), True), F.lit(0)).cast("int"), a)


def eligible_steps(steps: Column) -> Column:
    """Numbers of the steps that can be corrupted: all but the last with a result."""
    return F.filter(F.transform(steps, lambda s, i: F.when((i < F.size(steps) - 1) & s["result"].isNotNull(), i + 1)), lambda i: i.isNotNull())


def preferred_steps(length: Column) -> Column:
    """Steps to corrupt, by preference: the middle one, the next, the one before; within 1 and length - 1."""
    m = F.floor(length / 2).cast("int")
    return F.array_distinct(F.filter(F.array(m, m + 1, m - 1), lambda s: s.between(1, length - 1)))


def inject(steps: Column, a: Column, number: Column, wrong: Column) -> Column:
    """Steps with the result of one step replaced, and what follows reduced anew; null if nothing fits.

    wrong: places of symbols in the order in which they are tried; the first that differs from the
    step's result and changes the final symbol counts. The step must be an eligible one.
    """
    last = F.get(F.try_element_at(steps, F.lit(-1))["after"], F.lit(0))

    after = lambda s, w: let(_redex(s["before"], a), lambda r: _splice(s["before"], r, a, F.array(w)))

    def build(s: Column) -> Column:
        tried = F.filter(wrong, lambda w: (w != s["result"]) & (evaluate(after(s, w), a) != last))
        made = lambda w: F.struct(s["rule"].alias("rule"), w.alias("result"), s["before"].alias("before"), after(s, w).alias("after"))
        whole = lambda m: F.concat(F.slice(steps, F.lit(1), number - 1), F.array(m), reduce_steps(m["after"], a))
        return let(F.get(tried, F.lit(0)), lambda w: F.when(w.isNotNull(), let(made(w), whole)))

    return F.when(F.array_contains(eligible_steps(steps), number), let(F.get(steps, number - 1), build))


def render(rpn: Column, a: Column, signs: bool = True) -> Column:
    """Infix text: "(l sign r)", "t(x)" or a symbol, with operators by sign or by name."""
    shown = a["signs"] if signs else a["names"]

    def step(stack: Column, t: Column) -> Column:
        n, k = F.size(stack), -1 - t
        under = lambda m: F.slice(stack, F.lit(1), F.greatest(n - m, F.lit(0)))
        x, y, op = F.get(stack, n - 2), F.get(stack, n - 1), F.get(shown, k)
        two = F.concat(F.lit("("), x, F.lit(" "), op, F.lit(" "), y, F.lit(")"))
        return (
            F.when(t >= 0, F.concat(stack, F.array(F.get(a["symbols"], t))))
            .when(k < a["binary"], F.concat(under(2), F.array(two)))
            .otherwise(F.concat(under(1), F.array(F.concat(op, F.lit("("), y, F.lit(")")))))
        )

    return F.aggregate(rpn, F.array().cast("array<string>"), step, lambda stack: F.when(F.size(stack) == 1, F.get(stack, F.lit(0))))


def rule_name(rule: Column, a: Column) -> Column:
    """How a step names its rule."""
    sign = F.get(a["signs"], rule)
    return F.when(rule < a["base"], F.concat(sign, F.lit(" table"))).when(rule < a["binary"], F.concat(F.lit("definition of "), sign)).otherwise(sign)


def rule_type(rule: Column, a: Column) -> Column:
    return F.when(rule < a["base"], "base_op").when(rule < a["binary"], "derived_op").when(rule < F.size(a["names"]), "transform")


def render_step(step: Column, number: Column, a: Column) -> Column:
    return F.concat(F.lit("Step "), number.cast("string"), F.lit(": "), render(step["before"], a), F.lit(" = "), render(step["after"], a), F.lit("    [by "), rule_name(step["rule"], a), F.lit("]"))


def _start(rpn: Column, a: Column, steps: Column) -> Column:
    return F.concat(F.array(F.concat(F.lit("Start: "), render(rpn, a)), F.lit("")), F.transform(steps, lambda s, i: render_step(s, i + 1, a)))


def clean_derivation(rpn: Column, steps: Column, a: Column) -> Column:
    """The whole derivation as text, with its final symbol."""
    last = F.get(F.coalesce(F.try_element_at(steps, F.lit(-1))["after"], rpn), F.lit(0))
    return F.array_join(F.concat(_start(rpn, a, steps), F.array(F.lit(""), F.concat(F.lit("Final Output: "), F.get(a["symbols"], last)))), "\n")


def prefill(rpn: Column, steps: Column, a: Column, cutoff: Column) -> Column:
    """The derivation's text up to a step; a cutoff below 1 or beyond the last step fails the job."""
    fine = cutoff.between(1, F.size(steps))
    text = F.array_join(_start(rpn, a, F.slice(steps, F.lit(1), cutoff)), "\n")
    return F.when(fine, text).when(fine.isNotNull(), F.raise_error(F.concat(F.lit("the cutoff is outside the derivation's steps: "), cutoff.cast("string"))).cast("string"))
