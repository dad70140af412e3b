"""Seeded systems and datasets: what must hold for every row, and the sink around them."""

import hashlib
import itertools
import json

import pytest
from derivanta.functions import cells, conversations, expressions, scoring
from derivanta.operators import generation, report
from derivanta.sources import dataset
from derivanta.sources.jsonl import SYSTEM, read_jsonl
from derivanta.sources.scratch import Scratch
from pyspark.sql import functions as F


def plain_value(tokens, symbols, table, moves, made, ops):
    """Of postfix tokens, by the system's own tables."""
    names = [*[o["name"] for o in ops], *[d["name"] for d in made]]
    stack = []
    for t in tokens:
        k = -1 - t
        if t >= 0:
            stack.append(symbols[t])
        elif k >= len(names):
            stack.append(moves[k - len(names)]["mapping"][stack.pop()])
        else:
            y, x = stack.pop(), stack.pop()
            at = lambda o, x, y: table[o][f"{x},{y}"]
            if k < len(ops):
                stack.append(at(names[k], x, y))
            else:
                d = made[k - len(ops)]
                o = d["base_ops"][0]
                stack.append(at(o, at(o, x, y), x) if d["template_id"] == "compose_left" else at(o, at(o, x, x), y) if d["template_id"] == "double_left" else moves[0]["mapping"][at(o, x, y)])
    assert len(stack) == 1
    return stack[0]


def digest(*names):
    return hashlib.md5(":".join(map(str, names)).encode()).hexdigest()[:8]


def draw(below, *names):
    return int(digest(*names), 16) % below


def shuffled(n, *names):
    return sorted(range(n), key=lambda i: (digest(*names, i), i))


def plain_system(seed, n, ops, made, moves):
    """A system as with_systems draws it, with tables and orbits walked one by one."""
    pool = [generation.SYMBOLS[i] for i in shuffled(len(generation.SYMBOLS), seed, "symbol")[:n]]
    step = list(range(n))
    for t in itertools.count() if moves else ():
        step = now = shuffled(n, seed, "move", t)
        fine = True
        for _ in range(moves):
            fine, now = fine and now != list(range(n)), [step[i] for i in now]
        if fine:
            break
    tables = []
    for o in range(ops):
        t = {}
        for x, y in itertools.product(range(n), repeat=2):
            orbit, at = [], (x, y)
            while at not in orbit:
                orbit.append(at)
                at = step[at[0]], step[at[1]]
            if (x, y) != min(orbit):
                continue

            def moved(r, k):
                for _ in range(k):
                    r = step[r]
                return r

            fixed = [r for r in range(n) if moved(r, len(orbit)) == r]
            r = fixed[draw(len(fixed), seed, "cell", o, x * n + y)]
            for k, at in enumerate(orbit):
                t[at] = moved(r, k)
        tables.append(t)
    maps, now = [], step
    for _ in range(moves):
        maps.append(now)
        now = [step[i] for i in now]
    templates = [expressions.TEMPLATES[i] for i in shuffled(3, seed, "template") if moves or i != 1][:made]
    show = lambda i: pool[i]
    return {
        "name": f"{generation.FIRST_NAMES[draw(16, seed, 'first')]} {generation.LAST_NAMES[draw(6, seed, 'last')]}",
        "seed": seed,
        "symbols": pool,
        "base_operations": [{"name": f"op{o}", "symbol_id": generation.SIGNS[o], "table": {f"{show(x)},{show(y)}": show(t[x, y]) for x, y in itertools.product(range(n), repeat=2)}} for o, t in enumerate(tables)],
        "derived_operations": [{"name": f"dop{i}", "symbol_id": generation.SIGNS[ops + i], "template_id": t, "base_ops": [f"op{draw(ops, seed, 'base', i)}"], "transform_name": generation.MOVES[0] if t == "inv_compose" else None} for i, t in enumerate(templates)],
        "transformations": [{"name": generation.MOVES[k], "mapping": {show(x): show(y) for x, y in enumerate(m)}, "distributes_over": [f"op{o}" for o in range(ops)]} for k, m in enumerate(maps)],
    }


def plain_expression(seed, length, n, ops, made, moves):
    rpn, left, i = [draw(n, seed, "symbol", 0)], length, 0
    while left > 0:
        i += 1
        some = made if left >= 3 else 0
        kind = draw(ops + some + moves, seed, "kind", i)
        places = [p for p, t in enumerate(rpn) if t >= 0]
        at = places[draw(len(places), seed, "place", i)]
        if kind >= ops + some:
            new = [rpn[at], -1 - (ops + made) - (kind - ops - some)]
        else:
            two = [rpn[at], draw(n, seed, "symbol", i)]
            new = [*(two if draw(2, seed, "side", i) == 0 else two[::-1]), -1 - kind]
        rpn = rpn[:at] + new + rpn[at + 1 :]
        left -= 3 if ops <= kind < ops + some else 1
    return rpn


SIZE = "n int, ops int, made int, moves int"


@pytest.fixture(scope="module")
def systems(spark):
    """60 seeds of each size, with the system that is drawn."""
    rows = spark.createDataFrame([(seed, *s[:4]) for s in generation.SIZES.values() for seed in range(60)] + [(7, 3, 1, 1, 0), (8, 4, 2, 2, 3), (9, 8, 1, 0, 1)], f"system_seed long, {SIZE}")
    return [(tuple(r)[:5], json.loads(r.system_json)) for r in generation.with_systems(rows).drop("system").collect()]


def test_systems(systems):
    for (seed, n, ops, made, moves), s in systems:
        assert s == plain_system(seed, n, ops, made, moves)
        assert len(set(s["symbols"])) == n and set(s["symbols"]) <= set(generation.SYMBOLS)
        assert [len(s[k]) for k in ("base_operations", "derived_operations", "transformations")] == [ops, made, moves]
        signs = [o["symbol_id"] for o in s["base_operations"] + s["derived_operations"]]
        assert signs == generation.SIGNS[: len(signs)]
        for o in s["base_operations"]:
            assert set(o["table"]) == {f"{x},{y}" for x, y in itertools.product(s["symbols"], repeat=2)} and set(o["table"].values()) <= set(s["symbols"])
            for t in s["transformations"]:
                m = t["mapping"]
                assert sorted(m.values()) == sorted(s["symbols"]) and any(k != v for k, v in m.items())
                assert all(m[r] == o["table"][f"{m[k.split(',')[0]]},{m[k.split(',')[1]]}"] for k, r in o["table"].items())


def test_draws_are_spread(systems):
    """No symbol, result, sign of the first name or template is left out; tables without a transform are any magma."""
    easy = [s for (_, n, _, _, moves), s in systems if n == 3 and not moves]
    assert len({x for s in easy for x in s["symbols"]}) == len(generation.SYMBOLS)
    results = [s["symbols"].index(r) for s in easy for r in s["base_operations"][0]["table"].values()]
    assert all(150 < results.count(i) < 240 for i in range(3))
    assert len({s["name"].split()[0] for _, s in systems}) >= 12
    assert {d["template_id"] for _, s in systems for d in s["derived_operations"]} == set(expressions.TEMPLATES)


def test_expressions_take_the_length_asked_for(spark):
    sizes = [s[:4] for s in generation.SIZES.values()]
    rows = [(seed, length, *s) for s in sizes for seed in range(12) for length in (1, 2, 3, 6, 14, 40)] + [(1, 0, *sizes[3])]
    df = spark.createDataFrame(rows, f"seed long, length int, {SIZE}")
    got = df.select("seed", "length", "n", "ops", "made", "moves", generation.drawn_expression(F.col("seed"), F.col("length"), *[F.col(c) for c in ("n", "ops", "made", "moves")]).alias("rpn")).collect()
    for r in got:
        assert r.rpn == plain_expression(*r[:6])
        derived = sum(r.ops <= -1 - t < r.ops + r.made for t in r.rpn)
        assert sum(t < 0 for t in r.rpn) + 2 * derived == r.length
    assert len({tuple(r.rpn) for r in got}) > 0.8 * len(got)


@pytest.fixture(scope="module")
def made(spark):
    rows, rejected, bases = generation.generate(spark, "tiny", 18, 20260413)
    rows = Scratch(spark, "test-records").save(rows, "rows")
    return rows, rejected, bases


def test_records(made):
    rows = sorted((r.asDict() for r in made[0].collect()), key=lambda r: r["example_id"])
    assert [r["example_id"] for r in rows] == [f"tiny-{i:06d}" for i in range(18)] and list(rows[0]) == generation.RECORD
    assert [r["difficulty"] for r in rows] == ["easy"] * 5 + ["medium"] * 5 + ["hard"] * 4 + ["expert"] * 4
    assert made[2] == 1 + max(int(r["base_id"].split("-")[1]) for r in rows)
    for r in rows:
        place, base = [*generation.SIZES].index(r["difficulty"]), int(r["base_id"].split("-")[1])
        root = 20260413 * 1_000_000 + place * 10_000 + base * 100
        assert (r["system_seed"], r["error_seed"]) == (root + 11, root + 101) and root + 29 <= r["chain_seed"] < root + 29 + 250
        n, ops, made_, moves, length = generation.SIZES[r["difficulty"]]
        assert json.loads(r["system_json"]) == plain_system(r["system_seed"], n, ops, made_, moves) and r["target_step_count"] == r["chain_length_x"] == length
        s = json.loads(r["system_json"])
        tokens = plain_expression(r["chain_seed"], length, n, ops, made_, moves)
        tables = {o["name"]: o["table"] for o in s["base_operations"]}
        assert r["ground_truth_final_output"] == plain_value(tokens, s["symbols"], tables, s["transformations"], s["derived_operations"], s["base_operations"])
        x, y = r["chain_length_x"], r["prefill_error_step"]
        assert x >= 4 and abs(y - x // 2) <= 1 and 1 <= y <= x - 1 and r["wrong_branch_final_output"] != r["ground_truth_final_output"]
        clean, prefill = r["clean_derivation"].split("\n"), r["turn_1_assistant_prefill"].split("\n")
        assert clean[0].startswith("Start: ") and clean[-1] == f"Final Output: {r['ground_truth_final_output']}" and len(clean) == x + 4
        assert prefill[: y + 1] == clean[: y + 1] and len(prefill) == y + 2 and prefill[-1] != clean[y + 1] and prefill[-1].startswith(f"Step {y}: ")
        assert clean[0][7:] in r["turn_1_user"] and s["name"] in r["turn_1_user"] and r["turn_1_user"].endswith("Final Output: <single symbol>")


def test_generated_text_is_valid(spark, made):
    """The derivation checker accepts the clean text and rejects the corrupted step."""
    from derivanta.functions.derivations import validate

    rows = made[0].withColumn("system", F.from_json("system_json", SYSTEM))
    clean = validate(rows.withColumn("raw_continuation_text", F.col("clean_derivation")), F.col("system")).select("verdict.*").collect()
    assert all(v.derivation_valid and v.terminal_matches_gt for v in clean)
    bad = validate(rows.withColumn("raw_continuation_text", F.col("turn_1_assistant_prefill")), F.col("system")).select("prefill_error_step", "verdict.*").collect()
    assert all(not v.derivation_valid and v.first_invalid_step == v.prefill_error_step for v in bad)


def test_control_rows(made):
    rows = {r.example_id: r for r in made[0].collect()}
    for c in generation.control_rows(made[0]).collect():
        r = rows[c.example_id.removesuffix("-control")]
        assert c.condition == "clean_control" and c.has_prefill_error is False and c.error_type == "E-CONTINUE-CONTROL"
        y = r.prefill_error_step
        assert c.turn_1_assistant_prefill.split("\n") == r.clean_derivation.split("\n")[: y + 2] and c.clean_derivation == r.clean_derivation
    with pytest.raises(Exception, match="seeds give another row"):
        generation.control_rows(made[0].withColumn("chain_length_x", F.col("chain_length_x") + 1)).collect()


def test_dataset_sink(spark, made, tmp_path):
    rows, path = made[0], str(tmp_path / "set")
    counts = {d: generation.SIZES[d][4] for d in generation.SIZES}
    about = dataset.manifest(rows, "tiny", 20260413, counts, {}, 5)
    assert about["split_counts"] == {"train": 0, "validation": 0, "test": 18} and about["difficulty_counts"]["easy"] == 5 and about["error_type_counts"] == {"E-CONTINUE": 18}
    dataset.write_dataset(rows, path, about, "A set", "Some rows.")
    assert dataset.read_manifest(spark, path) == about and dataset.read_manifest(spark, str(tmp_path)) is None
    back = read_jsonl(spark, cells.split_path(path, True), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    text = (tmp_path / "set" / "README.md").read_text()
    assert "- total_examples: 18" in text and "- `chain_length_x`: steps" in text and not (tmp_path / "set" / "train.jsonl").exists()
    (tmp_path / "summary.json").write_text(json.dumps({"input_path": path}))
    (tmp_path / "broken.json").write_text("{")
    found = [dataset.dataset_path(spark, str(tmp_path / f)) for f in ("summary.json", "broken.json", "none.json")]
    assert found == [f"{path}/test.jsonl", None, None] and dataset.dataset_path(spark, "x", explicit="a.jsonl") == "a.jsonl"


def test_small_helpers(spark):
    assert dataset.length_overrides("Easy=5, hard=12", {"easy": 6, "hard": 10}) == {"easy": 5, "hard": 12} and dataset.length_overrides(None, {"a": 1}) == {"a": 1}
    for bad in ("easy", "odd=3"):
        with pytest.raises(ValueError):
            dataset.length_overrides(bad, {"easy": 6})
    assert cells.score_paths("a/b/predictions.jsonl")["scores"] == "a/b/scores.jsonl" and cells.eval_paths("x")["summary"] == "x/summary.json"
    rows = spark.range(5).select(F.format_string("e%d", "id").alias("example_id"), F.lit(1).alias("split"))
    assert conversations.metadata(rows).columns == ["example_id", "split"]
    with pytest.raises(ValueError, match="mode"):
        scoring.score_rows(spark.createDataFrame([(1,)], "example_id int"))
    with pytest.raises(Exception, match="unknown level"):
        spark.range(1).select(conversations.turn_2(F.lit(2))).collect()
    a = expressions.compile_system(F.from_json(F.lit(json.dumps(plain_system(1, 3, 1, 0, 0))), SYSTEM))
    for cutoff in (0, 2):
        with pytest.raises(Exception, match="cutoff"):
            r = F.array(F.lit(0), F.lit(1), F.lit(-1))
            spark.range(1).select(a.alias("a"), r.alias("r")).select(expressions.prefill(F.col("r"), expressions.reduce_steps(F.col("r"), F.col("a")), F.col("a"), F.lit(cutoff))).collect()


def test_rate_rounds_by_the_double(spark):
    """Every fraction that ends in a five at the fifth digit, some of many denominators, and zero."""
    pairs = [(2 * k + 1, 20_000) for k in range(10_000)] + [(j, 32) for j in range(33)] + [(n, d) for d in range(1, 150) for n in range(d + 1)] + [(0, 0), (123_457, 20_000 * 37)]
    got = spark.createDataFrame(pairs, "n long, d long").select("n", "d", report.rate(F.col("n"), F.col("d")).alias("r")).collect()
    assert [r for r in got if r.r != (round(r.n / r.d, 4) if r.d else 0.0)] == []


def test_deep_expressions(spark):
    """Too many symbols for one number: the stack of arrays gives the same."""
    s = plain_system(5, 6, 2, 2, 2)
    a = expressions.compile_system(F.from_json(F.lit(json.dumps(s)), SYSTEM))
    tables = {o["name"]: o["table"] for o in s["base_operations"]}
    trees = [plain_expression(i, 60, 6, 2, 2, 2) for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in trees], "t array<int>").withColumn("a", a)
    got = rows.select(expressions.evaluate(F.col("t"), F.col("a")), expressions._evaluate_stack(F.col("t"), F.col("a"))).collect()
    want = [s["symbols"].index(plain_value(t, s["symbols"], tables, s["transformations"], s["derived_operations"], s["base_operations"])) for t in trees]
    assert max(map(len, trees)) > 40 and [g[0] for g in got] == want and [g[1] for g in got] == want
    broken = spark.createDataFrame([([-1],), ([0, -1],), ([0, 1],), ([],), ([0, 1, -1, -1],), ([9, 0, -1],)], "t array<int>").withColumn("a", a)
    assert all(r[0] is None for r in broken.select(expressions.evaluate(F.col("t"), F.col("a"))).collect())
