"""Seeded systems, expressions and corrupted derivations, as columns.

Everything that is drawn follows from a seed and a name (functions.draws), so a row is made where it
lies, and again if a task is lost. Reduction, corruption, text, rejection and quotas are expressions
over the drawn tables and postfix arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversations
from ..functions import expressions as ex
from ..functions.draws import draw, picked, shuffled
from ..sources.jsonl import SYSTEM
from ..sources.scratch import Scratch
from .algebra import permutation_order
from .numbering import numbered

#: Symbols, names, signs and templates of generated systems.
SYMBOLS = ["🦩", "🐙", "🦔", "🪼", "🦎", "🐌", "🧲", "🪣", "🪆", "🧿", "🪤", "🪩", "🍄", "🫧", "🪸", "🪻", "🌵", "🪨", "🧁", "🫐", "🥟", "🪺", "🧄", "🫑", "🪬", "🧊", "🪈", "🪭", "🧶", "🪵"]
FIRST_NAMES = ["Zelta", "Vorn", "Quix", "Drenn", "Flax", "Kova", "Myre", "Thal", "Orix", "Plith", "Bren", "Sylk", "Jace", "Nev", "Wren", "Cael"]
LAST_NAMES = ["Algebra", "System", "Calculus", "Structure", "Field", "Ring"]
SIGNS = ["⊕", "⊗", "⊛", "⊞"]
MOVES = ["inv", "rot", "flip", "dual"]
#: Difficulty -> symbols, base operators, derived operators, transforms, steps aimed at.
SIZES = {"easy": (3, 1, 0, 0, 6), "medium": (4, 1, 1, 1, 8), "hard": (5, 2, 1, 1, 10), "expert": (6, 2, 2, 2, 14)}
#: Tries for a permutation, chain seeds tried, least number of steps.
TRIES, CHAIN_SEEDS, LEAST_STEPS = 100, 250, 4
#: Other systems of one base: how far apart their seeds are (bases' own seeds are nearer), how many a query draws.
REDRAW_STRIDE, REDRAWS = 10**15, 50
RECORD = ["example_id", "base_id", "split", "difficulty", "error_type", "turn_1_user", "turn_1_assistant_prefill", "clean_derivation", "ground_truth_final_output", "wrong_branch_final_output", "chain_length_x", "prefill_error_step", "target_step_count", "system_json", "system_seed", "chain_seed", "error_seed"]


_INTS = "array<int>"


def _after(move: Column, other: Column) -> Column:
    """Two permutations, one after the other."""
    return F.transform(other, lambda i: F.get(move, i))


def drawn_move(seed: Column, n: Column, moves: Column) -> Column:
    """A permutation of n symbols that none of its first powers, moves of them, takes back to where all
    were: the first of up to TRIES drawn. Without transforms, the identity; null if none is found."""
    same = F.sequence(F.lit(0), n - 1).cast(_INTS)

    def fits(p: Column) -> Column:
        powers = F.aggregate(F.sequence(F.lit(1), moves), F.struct(same.alias("now"), F.lit(True).alias("ok")), lambda s, _: ex.let(_after(p, s["now"]), lambda now: F.struct(now.alias("now"), (s["ok"] & (now != same)).alias("ok"))))
        return powers["ok"]

    tried = lambda found, t: F.when(found.isNotNull(), found).otherwise(ex.let(shuffled(seed, n, "move", t), lambda p: F.when(fits(p), p)))
    return F.when(moves == 0, same).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast(_INTS), tried))


def powers(move: Column) -> Column:
    """The identity, the permutation, its square and so on, as many as its order."""
    same = F.sequence(F.lit(0), F.size(move) - 1).cast(_INTS)
    on = lambda done, _: F.concat(done, F.array(_after(move, F.element_at(done, -1))))
    return ex.let(permutation_order(move), lambda n: F.when(n == 1, F.array(same)).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), F.array(same), on)))


def drawn_table(seed: Column, name, n: Column, powers_: Column) -> Column:
    """n * n results, by left, then right operand, over which the permutation distributes.

    The permutation takes a pair of operands around an orbit. The result of the orbit's least pair is
    drawn among the symbols that the permutation has taken back to where they were when the pair comes back
    to itself; the others' results are this one, moved along.
    """
    order = F.size(powers_)

    def result(cell: Column) -> Column:
        orbit = F.transform(powers_, lambda p: F.get(p, (cell / n).cast("int")) * n + F.get(p, cell % n))

        def of(way: Column) -> Column:
            back = F.coalesce(F.nullif(F.array_position(F.slice(way, F.lit(2), order), cell), F.lit(0)).cast("int"), order)  # steps until the pair is itself
            least = F.array_min(way)
            ahead = F.array_position(way, least).cast("int") - 1  # steps to the least pair
            fixed = F.filter(F.sequence(F.lit(0), n - 1).cast(_INTS), lambda r: F.get(F.get(powers_, back % order), r) == r)
            first = ex.let(fixed, lambda rs: F.get(rs, draw(seed, F.size(rs), "cell", name, least)))
            return ex.let(first, lambda r: F.get(F.get(powers_, (order - ahead) % order), r))

        return ex.let(orbit, of)

    return F.transform(F.sequence(F.lit(0), n * n - 1).cast(_INTS), result)


def with_systems(rows: DataFrame) -> DataFrame:
    """rows (with system_seed, n, ops, made, moves: symbols, operators, derived ones, transforms) and system, of the
    schema sources.jsonl.SYSTEM, and system_json."""
    seed, n = F.col("system_seed"), F.col("n")
    upto = lambda end, f: F.when(end > 0, F.transform(F.sequence(F.lit(0), end - 1).cast(_INTS), f))
    drawn = rows.withColumn("_pool", F.transform(F.slice(shuffled(seed, len(SYMBOLS), "symbol"), F.lit(1), n), lambda i: picked(SYMBOLS, i)))
    drawn = drawn.withColumn("_powers", powers(drawn_move(seed, n, F.col("moves"))))
    drawn = drawn.withColumn("_tables", upto(F.col("ops"), lambda o: drawn_table(seed, o, n, F.col("_powers"))))
    pool = lambda i: F.get("_pool", i)
    pair = lambda c: F.concat_ws(",", pool((c / n).cast("int")), pool(c % n))
    table = lambda t: F.map_from_entries(F.transform(t, lambda r, c: F.struct(pair(c), pool(r))))
    op_name = lambda o: F.concat(F.lit("op"), o.cast("string"))
    base = F.transform("_tables", lambda t, o: F.struct(op_name(o).alias("name"), picked(SIGNS, o).alias("symbol_id"), table(t).alias("table")))
    # Without a transform there is no operator by one.
    templates = F.filter(shuffled(seed, len(ex.TEMPLATES), "template"), lambda i: (F.col("moves") > 0) | (i != ex.TEMPLATES.index("inv_compose")))
    templates = F.slice(templates, F.lit(1), F.col("made"))
    moved = lambda t: F.when(t == ex.TEMPLATES.index("inv_compose"), MOVES[0])
    derived = F.transform(templates, lambda t, i: F.struct(F.concat(F.lit("dop"), i.cast("string")).alias("name"), picked(SIGNS, F.col("ops") + i).alias("symbol_id"), picked([*ex.TEMPLATES], t).alias("template_id"), F.array(op_name(draw(seed, F.col("ops"), "base", i))).alias("base_ops"), moved(t).alias("transform_name")))
    mapping = lambda k: F.map_from_entries(F.transform(F.get("_powers", k + 1), lambda y, x: F.struct(pool(x), pool(y))))
    maps = upto(F.col("moves"), lambda k: F.struct(picked(MOVES, k).alias("name"), mapping(k).alias("mapping"), F.transform("_tables", lambda _, o: op_name(o)).alias("distributes_over")))
    name = F.concat_ws(" ", picked(FIRST_NAMES, draw(seed, len(FIRST_NAMES), "first")), picked(LAST_NAMES, draw(seed, len(LAST_NAMES), "last")))
    fields = {"name": name, "seed": seed, "symbols": F.col("_pool"), "base_operations": base, "derived_operations": derived, "transformations": F.coalesce(maps, F.array())}
    system = F.struct(*[v.alias(k) for k, v in fields.items()]).cast(_struct(SYSTEM))
    return drawn.withColumn("system", system).withColumn("system_json", system_to_json(F.col("system"))).drop("_pool", "_powers", "_tables")


def _struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()


def system_to_json(system: Column) -> Column:
    """A system as JSON: an object with the schema's fields in order, nulls too; from_json with SYSTEM gives it back."""
    return F.to_json(system, {"ignoreNullFields": "false"})


def drawn_expression(seed: Column, length: Column, n: Column, ops: Column, made: Column, moves: Column) -> Column:
    """Postfix tokens (see functions.expressions) of an expression whose reduction takes exactly length steps.

    It starts as a symbol. While steps are left, a drawn symbol of it becomes the operand of a drawn operator or
    transform, beside a new symbol, to the left or the right: an operator or a transform takes one
    step, a derived operator three, so that it is drawn only while three are left.
    """
    binary = ops + made

    def grow(s: Column, i: Column) -> Column:
        some = F.when(s["left"] >= 3, made).otherwise(0)
        kind = draw(seed, ops + some + moves, "kind", i)
        token = F.when(kind < ops + some, -1 - kind).otherwise(-1 - binary - (kind - ops - some))
        places = F.filter(F.transform(s["rpn"], lambda t, p: F.when(t >= 0, p + 1)), lambda p: p.isNotNull())
        at = ex.let(places, lambda ps: F.get(ps, draw(seed, F.size(ps), "place", i)))

        def put(p: Column) -> Column:
            old, new = F.get(s["rpn"], p - 1), draw(seed, n, "symbol", i)
            operands = F.when(kind >= ops + some, F.array(old)).when(draw(seed, 2, "side", i) == 0, F.array(old, new)).otherwise(F.array(new, old))
            rpn = F.concat(F.slice(s["rpn"], F.lit(1), p - 1), operands, F.array(token.cast("int")), F.slice(s["rpn"], p + 1, F.size(s["rpn"])))
            cost = F.when((kind >= ops) & (kind < ops + some), 3).otherwise(1)
            return F.struct(rpn.alias("rpn"), (s["left"] - cost).alias("left"))

        return F.when(s["left"] <= 0, s).otherwise(ex.let(at, put))

    start = F.struct(F.array(draw(seed, n, "symbol", 0)).alias("rpn"), length.cast("int").alias("left"))
    return F.when(length < 1, start["rpn"]).otherwise(F.aggregate(F.sequence(F.lit(1), length), start, grow, lambda s: s["rpn"]))


def with_chains(rows: DataFrame) -> DataFrame:
    """rows (with chain_seed, error_seed, target_step_count, sizes) and rpn, and tries: in which order wrong symbols
    are tried."""
    rpn = drawn_expression(F.col("chain_seed"), F.col("target_step_count"), *[F.col(c) for c in ("n", "ops", "made", "moves")])
    return rows.withColumn("rpn", rpn).withColumn("tries", shuffled(F.col("error_seed"), F.col("n") - 1, "try"))


def bases(spark: SparkSession, master_seed: int, wanted: dict[str, tuple[int, int]], lengths: dict[str, int] | None = None) -> DataFrame:
    """difficulty -> (first, end) of its base numbers: a row a base, with its seeds and sizes."""
    sizes = [(d, i, *SIZES[d][:4], (lengths or {}).get(d, SIZES[d][4]), *wanted[d]) for i, d in enumerate(SIZES) if d in wanted]
    rows = spark.createDataFrame(sizes, "difficulty string, place long, n int, ops int, made int, moves int, target_step_count int, first long, end long").where("first < end")
    rows = rows.withColumn("base_index", F.explode(F.sequence(F.col("first"), F.col("end") - 1))).drop("first", "end")
    root = F.lit(master_seed).cast("long") * 1_000_000 + F.col("place") * 10_000 + F.col("base_index") * 100
    return rows.withColumn("root", root).withColumn("system_seed", root + 11).withColumn("error_seed", root + 101)


def with_instances(rows: DataFrame) -> DataFrame:
    """rows (with system_json, rpn, tries) and system, a (compiled), steps, error_step, mutated and reason.

    The middle step is corrupted, or the next, or the one before, whichever first can be; reason says why
    a row is passed over and is null for the others.
    """
    a, steps = F.col("a"), F.col("steps")
    rows = rows.withColumn("system", F.from_json("system_json", SYSTEM)).withColumn("a", ex.compile_system(F.col("system")))
    rows = rows.withColumn("steps", ex.reduce_steps(F.col("rpn"), a)).withColumn("eligible", ex.eligible_steps(steps))
    rows = rows.withColumn("candidates", F.array_intersect(ex.preferred_steps(F.size(steps)), "eligible"))

    def wrong(number: Column) -> Column:
        others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda s: s != F.get(steps, number - 1)["result"])
        return ex.let(others, lambda o: F.transform("tries", lambda i: F.get(o, i)))

    tried = F.transform("candidates", lambda c: F.struct(c.alias("error_step"), ex.inject(steps, a, c, wrong(c)).alias("mutated")))
    rows = rows.withColumn("hit", F.get(F.filter(tried, lambda t: t["mutated"].isNotNull()), F.lit(0))).select("*", "hit.*").drop("hit")
    x = F.size(steps)
    reason = (
        F.when(F.size("eligible") == 0, "no_eligible_in_chain")
        .when(F.size("candidates") == 0, "no_eligible_in_window")
        .when(F.col("mutated").isNull(), "cascade_convergent")
        .when(x < LEAST_STEPS, "chain_too_short")
        .when(F.size("mutated") - F.col("error_step") < F.ceil(x / 2), "insufficient_runway")
    )
    return rows.withColumn("reason", reason)


def records(rows: DataFrame, dataset: str) -> DataFrame:
    """The dataset's rows of instances (with example_index)."""
    a, steps = F.col("a"), F.col("steps")
    last = lambda s: F.get(a["symbols"], F.get(F.try_element_at(s, F.lit(-1))["after"], F.lit(0)))
    out = rows.withColumns({
        "example_id": F.format_string(f"{dataset.replace('%', '%%')}-%06d", "example_index"),
        "base_id": F.format_string("%s-%04d", "difficulty", "base_index"),
        "split": F.lit("test"),
        "error_type": F.lit("E-CONTINUE"),
        "turn_1_user": conversations.turn_1_user(F.col("system"), ex.render(F.col("rpn"), a)),
        "turn_1_assistant_prefill": ex.prefill(F.col("rpn"), F.col("mutated"), a, F.col("error_step")),
        "clean_derivation": ex.clean_derivation(F.col("rpn"), steps, a),
        "ground_truth_final_output": last(steps),
        "wrong_branch_final_output": last(F.col("mutated")),
        "chain_length_x": F.size(steps),
        "prefill_error_step": F.col("error_step"),
    })
    return out.select(*RECORD)


def control_rows(rows: DataFrame) -> DataFrame:
    """Rows of a dataset with the clean text in place of the corrupted one, drawn anew from their seeds. A row
    whose length, step or clean text differs from what its seeds give fails the job."""
    sizes = rows.sparkSession.createDataFrame([(d, *s[:4]) for d, s in SIZES.items()], "difficulty string, n int, ops int, made int, moves int")
    again = rows.select("example_id", "difficulty", "system_json", "chain_seed", "error_seed", "target_step_count").join(F.broadcast(sizes), "difficulty")
    again = with_instances(with_chains(again))
    a, steps = F.col("a"), F.col("steps")
    again = again.select("example_id", F.size(steps).alias("x"), "error_step", ex.clean_derivation(F.col("rpn"), steps, a).alias("text"), ex.prefill(F.col("rpn"), steps, a, F.col("error_step")).alias("prefill"))
    same = (F.col("x") == F.col("chain_length_x")) & (F.col("error_step") == F.col("prefill_error_step")) & (F.col("clean_derivation").isNull() | (F.col("clean_derivation") == F.col("text")))
    drift = F.raise_error(F.concat(F.lit("seeds give another row than "), F.col("example_id"))).cast("string")
    joined = rows.join(again, "example_id").withColumn("prefill", F.when(F.coalesce(same, F.lit(False)), F.col("prefill")).otherwise(drift))
    new = {"example_id": F.concat("example_id", F.lit("-control")), "turn_1_assistant_prefill": F.col("prefill"), "clean_derivation": F.col("text"), "error_type": F.lit("E-CONTINUE-CONTROL")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], F.lit(False).alias("has_prefill_error"), F.lit("clean_control").alias("condition"))


def search(bases_: DataFrame, scratch: Scratch, redraws: int = 0) -> DataFrame:
    """Attempts at an instance for each base: with_instances of chain seeds in turn, with attempt and chain_seed, up
    to the base's first success or CHAIN_SEEDS of them.

    Attempts run in growing lots, for the bases without an instance yet; a few jobs, whatever their number. A lot
    may hold attempts after a base's first success.

    Some small systems take nearly every chain to one symbol, so that no corruption lasts. With redraws, a base
    whose attempts all failed gets another system, of a seed that system_json names, and its attempts go on
    with the next numbers; a base without an instance after that many other systems fails the job.
    """
    left, lots = bases_, []
    cores = bases_.sparkSession.sparkContext.defaultParallelism
    for k in range(redraws + 1):
        seeded = left.withColumn("_seed", F.col("system_seed")).withColumn("system_seed", F.col("system_seed") + F.lit(k * REDRAW_STRIDE))
        drawn = with_systems(seeded).withColumn("system_seed", F.col("_seed")).drop("_seed")
        left, low = scratch.save(drawn, "bases"), 0
        for high in (1, 4, 16, 64, CHAIN_SEEDS):
            attempt = F.explode(F.sequence(F.lit(k * CHAIN_SEEDS + low), F.lit(k * CHAIN_SEEDS + high - 1)))
            seeds = left.withColumn("attempt", attempt).withColumn("chain_seed", F.col("root") + 29 + F.col("attempt"))
            lot = scratch.save(with_instances(with_chains(seeds.repartition(cores, "base_index", "attempt"))), "attempts")
            lots.append(lot)
            left = left.join(lot.where("reason is null").select("difficulty", "base_index").distinct(), ["difficulty", "base_index"], "left_anti")
            low = high
            if left.isEmpty():
                return reduce(DataFrame.unionByName, lots)
        left = left.drop("system", "system_json")
    if redraws:
        raise RuntimeError(f"bases without an instance after {redraws} other systems")
    return reduce(DataFrame.unionByName, lots)


def choose(attempts: DataFrame, dataset: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejections, hits) of attempts of search: hits are (difficulty, base_index, attempt) of each base's
    first success, rejections (difficulty, base_index, attempt, reason) of the attempts before. Records
    are numbered by difficulty, then base."""
    place = F.array_position(F.array(*[F.lit(d) for d in SIZES]), F.col("difficulty"))
    first = attempts.where("reason is null").groupBy("difficulty", "base_index").agg(F.min("attempt").alias("attempt"))
    # Slim rows are numbered, and the wide ones join their numbers.
    hits = scratch.save(first.withColumn("level", place), "hits")
    numbers = numbered(hits, None, ["level", "base_index"], scratch).select("difficulty", "base_index", "attempt", F.col("place").alias("example_index"))
    chosen = attempts.join(numbers, ["difficulty", "base_index", "attempt"])
    before = attempts.where("reason is not null").join(hits.select("difficulty", "base_index", F.col("attempt").alias("hit")), ["difficulty", "base_index"], "left").where("hit is null or attempt < hit")
    return records(chosen, dataset), before.select("difficulty", "base_index", "attempt", "reason"), hits


def generate(spark: SparkSession, dataset: str, count: int, master_seed: int, lengths: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(records, rejections, bases): count rows, a fourth of them for each difficulty, of the first bases that give
    one; bases is the largest number of bases that a difficulty used. More bases follow if a difficulty needs them."""
    from .report import per_difficulty_quota

    if count < 1:
        raise ValueError("count must be at least 1")
    scratch = Scratch(spark, "generated")
    quota = per_difficulty_quota(count, [*SIZES])
    first, got, tried = dict.fromkeys(SIZES, 0), dict.fromkeys(SIZES, 0), []
    while any(got[d] < quota[d] for d in SIZES):
        if max(first.values()) >= 20_000:
            raise RuntimeError("too few bases give an instance")
        wanted = {d: (first[d], first[d] + quota[d] - got[d]) for d in SIZES if got[d] < quota[d]}
        tried.append(search(bases(spark, master_seed, wanted, lengths), scratch))
        hit = tried[-1].where("reason is null").select("difficulty", "base_index").distinct()
        for r in hit.groupBy("difficulty").agg(F.count("*").alias("n")).collect():  # four rows
            got[r["difficulty"]] += r["n"]
        first |= {d: end for d, (_, end) in wanted.items()}
    rows, rejected, hits = choose(reduce(DataFrame.unionByName, tried), dataset, scratch)
    return rows, rejected, hits.agg(F.max("base_index") + 1).first()[0]
