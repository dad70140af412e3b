"""Queries over systems and records that are drawn from the keys of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derivations import validate
from ..operators import algebra, generation
from ..sources.jsonl import SYSTEM
from ..sources.scratch import Scratch

MASTER = 20260413
_SIZES = [(i, d, *s) for i, (d, s) in enumerate(generation.SIZES.items())]


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base for each supplier: its key's remainder says the difficulty, the key is the base's number."""
    sizes = spark.createDataFrame(_SIZES, "place long, difficulty string, n int, ops int, made int, moves int, target_step_count int")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("base_index"), F.pmod("s_suppkey", F.lit(4)).cast("long").alias("place"))
    root = F.lit(MASTER * 1_000_000).cast("long") + F.col("place") * 10_000 + F.col("base_index") * 100
    return rows.join(F.broadcast(sizes), "place").withColumn("root", root).withColumn("system_seed", root + 11).withColumn("error_seed", root + 101)


def drawn_systems(rows: DataFrame) -> DataFrame:
    """Systems as their JSON gives them back: names, symbols, results of the tables row by row, images of the transforms,
    derived operators."""
    s = F.col("s")
    made = generation.with_systems(rows).select("base_index", F.from_json("system_json", SYSTEM).alias("s"))
    each = lambda items, f, sep: F.array_join(F.transform(items, f), sep)
    tables = each(s["base_operations"], lambda o: F.concat(o["symbol_id"], F.lit(":"), each(s["symbols"], lambda x: each(s["symbols"], lambda y: F.element_at(o["table"], F.concat_ws(",", x, y)), ""), "")), "|")
    moves = each(s["transformations"], lambda t: F.concat(t["name"], F.lit(":"), each(s["symbols"], lambda x: F.element_at(t["mapping"], x), "")), "|")
    derived = each(s["derived_operations"], lambda d: F.concat_ws(":", d["symbol_id"], d["template_id"], F.array_join(d["base_ops"], ","), d["transform_name"]), "|")
    return made.select(F.col("base_index").alias("s_suppkey"), s["name"].alias("name"), F.array_join(s["symbols"], "").alias("symbols"), tables.alias("tables"), moves.alias("moves"), derived.alias("derived"))


def undistributed(rows: DataFrame) -> DataFrame:
    """Of the drawn systems with transforms: entries of their tables, and those over which a transform doesn't distribute."""
    made = Scratch(rows.sparkSession, "systems").save(generation.with_systems(rows.where("moves > 0")).select("base_index", "system"), "systems")
    ops = made.select("base_index", F.explode("system.base_operations").alias("o")).select("base_index", F.col("o.name").alias("op"), F.explode("o.table").alias("k", "result"))
    at = F.split("k", ",")
    key = F.col("base_index").cast("string")
    table = ops.select(F.concat_ws("/", key, "op").alias("op"), *[F.concat_ws("/", key, x).alias(c) for c, x in (("lhs", at[0]), ("rhs", at[1]), ("result", F.col("result")))])
    maps = made.select("base_index", F.explode("system.transformations").alias("t")).select("base_index", F.col("t.name").alias("name"), F.explode("t.mapping").alias("src", "dst"))
    moves = maps.select(F.concat_ws("/", key, "name").alias("name"), F.concat_ws("/", key, "src").alias("src"), F.concat_ws("/", key, "dst").alias("dst"))
    wrong = algebra.distribution_counterexamples(table, moves).agg(F.count("*").alias("counterexamples"))
    moved = moves.where("src <> dst").agg(F.count("*").alias("moved"))
    return table.agg(F.count("*").alias("entries")).crossJoin(wrong).crossJoin(moved.select((F.col("moved") > 0).alias("some_move")))


def generated_records(rows: DataFrame) -> DataFrame:
    """A record for each base, and what the derivation checker says of its texts. A base whose system gives none has
    another drawn."""
    scratch = Scratch(rows.sparkSession, "records")
    made, _, _ = generation.choose(generation.search(rows, scratch, generation.REDRAWS), "made", scratch)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    made = scratch.save(made, "rows").repartition(cores, "example_id").withColumn("system", F.from_json("system_json", SYSTEM))
    clean = validate(made.withColumn("raw_continuation_text", F.col("clean_derivation")), F.col("system")).withColumnRenamed("verdict", "clean")
    both = validate(clean.withColumn("raw_continuation_text", F.col("turn_1_assistant_prefill")), F.col("system"))
    checks = {
        "clean_valid": F.col("clean.derivation_valid") & F.col("clean.terminal_matches_gt"),
        "error_found": ~F.col("verdict.derivation_valid") & (F.col("verdict.first_invalid_step") == F.col("prefill_error_step")),
        "branches_differ": F.col("ground_truth_final_output") != F.col("wrong_branch_final_output"),
        "near_middle": F.abs(F.col("prefill_error_step") - F.floor(F.col("chain_length_x") / 2)) <= 1,
        "begins_alike": F.startswith("clean_derivation", F.call_function("substring_index", "turn_1_assistant_prefill", F.lit("\nStep "), F.col("prefill_error_step").cast("int"))),
    }
    longs = [F.col(c).cast("long").alias(c) for c in ("chain_length_x", "target_step_count", "system_seed", "error_seed")]
    return both.select("example_id", "base_id", "split", "difficulty", "error_type", *longs, *[v.alias(k) for k, v in checks.items()])


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _digest(*names: str) -> str:
    return "substr(md5(concat_ws(':', " + ", ".join(names) + ")), 1, 8)"


def _draw(below: str, *names: str) -> str:
    return f"(('0x' || {_digest(*names)})::bigint % {below})"


_BASES = f"""with recursive z as (select * from (values {', '.join(f"({i}, '{d}', {n}, {ops}, {made}, {moves}, {x})" for i, d, n, ops, made, moves, x in _SIZES)}) v(place, difficulty, n, ops, made, moves, x)),
b as (select s_suppkey, z.*, {MASTER * 1_000_000} + place * 10000 + s_suppkey * 100 + 11 as seed from supplier join z on place = s_suppkey % 4)"""
_SYSTEMS = f"""{_BASES},
pool as (select seed, list_transform(list(i order by {_digest('seed', "'symbol'", 'i')}, i)[:any_value(n)], lambda i: {_sql_list(generation.SYMBOLS)}[i + 1]) as pool from b, range({len(generation.SYMBOLS)}) r(i) group by seed),
tried as (select seed, t, list(i order by {_digest('seed', "'move'", 't', 'i')}, i) as p, any_value(moves) as moves, range(any_value(n)) as same from b, range({generation.TRIES}) a(t), range(6) r(i) where i < n and moves > 0 group by seed, t),
move as (select seed, arg_min(p, t) as p from tried where p <> same and (moves < 2 or list_transform(p, lambda i: p[i + 1]) <> same) group by seed union all select seed, range(n) from b where moves = 0),
power as (select seed, 0 as k, p, range(len(p)) as q from move union all select seed, k + 1, p, list_transform(q, lambda i: p[i + 1]) from power where k < 6),
walk as (select seed, n, c, 0 as k, c as node from b, range(36) r(c) where c < n * n union all select w.seed, n, c, k + 1, p[node // n + 1] * n + p[node % n + 1] from walk w join move using (seed) where p[node // n + 1] * n + p[node % n + 1] <> c),
orbit as (select seed, any_value(n) as n, c, count(*) as back, min(node) as least, arg_min(k, node) as ahead from walk group by seed, c),
fixed as (select o.*, list_filter(range(n), lambda r: q[r + 1] = r) as rs from orbit o join power w on w.seed = o.seed and w.k = o.back),
cell as (select seed, o, c, q[rs[{_draw('len(rs)', 'seed', "'cell'", 'o', 'least')} + 1] + 1] as r from fixed f join b using (seed) join range(2) x(o) on o < ops join power w on w.seed = f.seed and w.k = back - ahead),
tab as (select seed, string_agg(t, '|' order by o) as tables from (select seed, o, {_sql_list(generation.SIGNS)}[o + 1] || ':' || string_agg(pool[r + 1], '' order by c) as t from cell join pool using (seed) group by seed, o) group by seed),
mov as (select seed, string_agg({_sql_list(generation.MOVES)}[k] || ':' || array_to_string(list_transform(q, lambda i: pool[i + 1]), ''), '|' order by k) as moves from power join pool using (seed) join b using (seed) where k between 1 and b.moves group by seed),
kind as (select seed, list(i order by {_digest('seed', "'template'", 'i')}, i)[:any_value(made)] as ts from b, range(3) r(i) where i <> 1 or moves > 0 group by seed),
der as (select seed, string_agg(concat_ws(':', {_sql_list(generation.SIGNS)}[ops + i + 1], ['compose_left', 'inv_compose', 'double_left'][ts[i + 1] + 1], 'op' || {_draw('ops', 'seed', "'base'", 'i')}, case when ts[i + 1] = 1 then 'inv' end), '|' order by i) as derived from b join kind using (seed), range(2) r(i) where i < made group by seed)
"""
ORACLES = {
    "drawn_systems": _SYSTEMS
    + f"""select s_suppkey, {_sql_list(generation.FIRST_NAMES)}[{_draw(str(len(generation.FIRST_NAMES)), 'seed', "'first'")} + 1] || ' ' || {_sql_list(generation.LAST_NAMES)}[{_draw(str(len(generation.LAST_NAMES)), 'seed', "'last'")} + 1] as name,
  array_to_string(pool, '') as symbols, tables, coalesce(mov.moves, '') as moves, coalesce(derived, '') as derived from b join pool using (seed) join tab using (seed) left join mov using (seed) left join der using (seed)""",
    "undistributed": _BASES + "select sum(ops * n * n)::bigint as entries, 0::bigint as counterexamples, true as some_move from b where moves > 0",
    "generated_records": _BASES
    + """select 'made-' || lpad((row_number() over (order by place, s_suppkey) - 1)::varchar, 6, '0') as example_id, difficulty || '-' || lpad(s_suppkey::varchar, greatest(4, length(s_suppkey::varchar))::int, '0') as base_id, 'test' as split, difficulty, 'E-CONTINUE' as error_type,
  x::bigint as chain_length_x, x::bigint as target_step_count, seed as system_seed, seed + 90 as error_seed, true as clean_valid, true as error_found, true as branches_differ, true as near_middle, true as begins_alike from b""",
}
