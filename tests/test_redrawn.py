"""Bases whose first system gives no instance."""

import json

import duckdb
import pytest
from derivanta.operators import generation
from derivanta.plans import drawn
from derivanta.plans.queries import ORACLES, QUERIES
from derivanta.sources.scratch import Scratch
from oracle import compare


def suppliers(tmp_path, *keys):
    duckdb.sql(f"copy (select unnest({[*keys]})::bigint as s_suppkey) to '{tmp_path}/supplier.parquet' (format parquet)")
    return str(tmp_path)


def test_a_record_for_every_base(spark, tmp_path):
    """1380's system takes nearly all chains to one symbol, 37844's table holds one symbol only."""
    assert compare(spark, QUERIES["generated_records"], ORACLES["generated_records"], suppliers(tmp_path, 1380, 1381, 37844)) == 3


@pytest.mark.parametrize("redraws", [0, 2])
def test_systems_drawn_anew(spark, tmp_path, monkeypatch, redraws):
    """The system names the seed of its draw, the other columns keep the base's; without redraws the base is left out."""
    monkeypatch.setattr(generation, "CHAIN_SEEDS", 65)
    found = generation.search(drawn.bases(spark, suppliers(tmp_path, 37844)), Scratch(spark, "again"), redraws).collect()
    base = 20260413 * 10**6 + 3784400
    assert {r.system_seed for r in found} == {base + 11}
    assert all(r.chain_seed == base + 29 + r.attempt for r in found)
    assert [r.attempt for r in found if r.attempt < 65 and r.reason is None] == []
    assert {json.loads(r.system_json)["seed"] for r in found if r.attempt < 65} == {base + 11}
    good = {json.loads(r.system_json)["seed"] for r in found if r.reason is None}
    assert good == (set() if redraws == 0 else {base + 11 + generation.REDRAW_STRIDE})
