"""Groups and prompt text against values worked out by hand."""

import json

from derivanta.functions.prompts import system_prompt
from derivanta.operators.groups import automorphisms, group_table
from derivanta.sources.jsonl import SYSTEM
from pyspark.sql import functions as F


def test_group_of_six(spark):
    labels = spark.createDataFrame([("g", s, i) for i, s in enumerate("qwerty")] + [("one", "z", 0)], "op string, symbol string, label int")
    table = group_table(labels)
    rows = {(r.op, r.lhs, r.rhs): r.result for r in table.collect()}
    assert len(rows) == 37 and rows["g", "y", "w"] == "q" and rows["one", "z", "z"] == "z"
    maps = {(r.op, r.k, r.src): r.dst for r in automorphisms(table).collect()}
    assert maps == {("g", 5, s): "qytrew"[i] for i, s in enumerate("qwerty")}


def test_no_group_and_no_rows(spark):
    table = spark.createDataFrame([("m", x, y, "a") for x in "abc" for y in "abc"], "op string, lhs string, rhs string, result string")
    assert automorphisms(table).collect() == []
    assert automorphisms(table.limit(0)).collect() == []


def test_prompt(spark):
    full = {
        "symbols": ["a", "b"],
        "base_operations": [{"name": "op0", "symbol_id": "⊕", "table": {"a,a": "b", "a,b": "a", "b,a": "a", "b,b": "b"}}],
        "derived_operations": [{"name": "d", "symbol_id": "⊗", "template_id": "double_left", "base_ops": ["op0"]}, {"symbol_id": "⊛", "template_id": "odd", "base_ops": []}],
        "transformations": [{"name": "inv", "mapping": {"b": "a", "a": "b"}, "distributes_over": ["op0", "d", "x"]}],
    }
    rows = spark.createDataFrame([(0, json.dumps(full)), (1, None), (2, "{}")], "i int, s string").withColumn("p", system_prompt(F.from_json("s", SYSTEM)))
    got = {r.i: r.p for r in rows.collect()}
    assert got[1] is None and got[2] == "Symbols: {}"
    note = "In the table below, the row is the left operand and the column is the right operand. For example, row a and column b means a ⊕ b."
    assert got[0] == "\n".join([
        "Symbols: {a, b}", "", "Operation ⊕ (defined by table):", note, "", "| ⊕ | a | b |", "|---|---|---|", "| **a** | b | a |", "| **b** | a | b |", "",
        "Derived operation ⊗:", "x ⊗ y = (x ⊕ x) ⊕ y", "", "Derived operation ⊛: odd", "",
        'Transformation "inv":', "  inv(b) = a", "  inv(a) = b", "  Distribution property: inv(x ⊕ y) = inv(x) ⊕ inv(y)", "  Distribution property: inv(x ⊗ y) = inv(x) ⊗ inv(y)", "  Distribution property: inv(x x y) = inv(x) x inv(y)",
    ])
