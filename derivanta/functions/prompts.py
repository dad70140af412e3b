"""Systems as prompt text: Markdown tables and rules, by higher-order functions within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts of the prompt format.
TABLE_TITLE = "Operation %s (defined by table):\n"
TABLE_NOTE = "In the table below, the row is the left operand and the column is the right operand. For example, row a and column b means a %s b.\n\n"
DERIVED_TITLE = "Derived operation %s:"
TRANSFORM_TITLE = 'Transformation "%s":'
MAPS_TO = "  %s(%s) = %s"
DISTRIBUTES = "  Distribution property: %s(x %s y) = %s(x) %s %s(y)"
UNKNOWN_BASE = "[base]"


def _lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def _each(items: Column, text) -> Column:
    """Texts of an array's items; an empty array for null."""
    return F.coalesce(F.transform(items, text), F.array().cast("array<string>"))


def system_prompt(system: Column) -> Column:
    """The text of a system of the schema sources.jsonl.SYSTEM: symbols, tables, derived operators and
    transforms, with a blank line between. Names of base operators appear as their signs.

    A null system is null; null lists count as empty; a table cell that is missing is empty.
    """
    symbols, signs = system["symbols"], system["base_operations"]
    named = F.concat(*[_pairs(system[k]) for k in ("base_operations", "derived_operations")])
    sign_of = lambda name: F.get(F.filter(named, lambda p: p["name"] == name), F.lit(0))["sign"]
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(o: Column) -> Column:
        sign = o["symbol_id"]
        cell = lambda x, y: F.coalesce(F.try_element_at(o["table"], F.concat_ws(",", x, y)), F.lit(""))
        body = F.transform(symbols, lambda x: row(F.concat(F.array(F.concat(F.lit("**"), x, F.lit("**"))), F.transform(symbols, lambda y: cell(x, y)))))
        rule = F.concat(F.lit("|---|"), F.array_join(F.transform(symbols, lambda _: F.lit("---")), "|"), F.lit("|"))
        return F.concat(F.format_string(TABLE_TITLE + TABLE_NOTE, sign, sign), _lines(F.concat(F.array(row(F.concat(F.array(sign), symbols)), rule), body)))

    def derived(d: Column) -> Column:
        base, sign = F.coalesce(sign_of(F.get(d["base_ops"], F.lit(0))), F.lit(UNKNOWN_BASE)), d["symbol_id"]
        meaning = (
            F.when(d["template_id"] == "compose_left", F.format_string("(x %s y) %s x", base, base))
            .when(d["template_id"] == "inv_compose", F.format_string("%s(x %s y)", d["transform_name"], base))
            .when(d["template_id"] == "double_left", F.format_string("(x %s x) %s y", base, base))
        )
        title = F.format_string(DERIVED_TITLE, sign)
        return F.when(meaning.isNull(), F.concat_ws(" ", title, d["template_id"])).otherwise(F.concat(title, F.format_string("\nx %s y = ", sign), meaning))

    def moved(t: Column) -> Column:
        name = t["name"]
        maps = _each(F.map_entries(t["mapping"]), lambda e: F.format_string(MAPS_TO, name, e["key"], e["value"]))
        spread = lambda o: F.format_string(DISTRIBUTES, name, o, name, o, name)
        return _lines(F.concat(F.array(F.format_string(TRANSFORM_TITLE, name)), maps, _each(t["distributes_over"], lambda o: spread(F.coalesce(sign_of(o), o)))))

    head = F.concat(F.lit("Symbols: {"), F.coalesce(F.array_join(symbols, ", "), F.lit("")), F.lit("}"))
    parts = F.concat(F.array(head), _each(signs, table), _each(system["derived_operations"], derived), _each(system["transformations"], moved))
    return F.when(system.isNotNull(), F.array_join(parts, "\n\n"))


def _pairs(ops: Column) -> Column:
    kind = "array<struct<name:string,sign:string>>"
    return F.coalesce(F.transform(ops, lambda o: F.struct(o["name"].alias("name"), o["symbol_id"].alias("sign"))), F.array().cast(kind))
