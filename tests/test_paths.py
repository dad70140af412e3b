import itertools
import random

import pytest
from derivanta.functions import expressions as ex
from pyspark.sql import functions as F

#: Two operators and a transform over three symbols: tokens -1, -2 and -3.
SYSTEM = "named_struct('symbols', array('0', '1', '2'), 'base_operations', array(named_struct('name', 'o', 'symbol_id', '#', 'table', map('0,0', '0'))), 'derived_operations', array(named_struct('name', 'd', 'symbol_id', '&', 'template_id', 'double_left', 'base_ops', array('o'), 'transform_name', cast(null as string))), 'transformations', array(named_struct('name', 't', 'mapping', map('0', '1'), 'distributes_over', array('o'))))"


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.randrange(3)
    if kind < 0.45:
        return ("t", tree(rng, depth - 1))
    return (rng.choice("od"), tree(rng, depth - 1), tree(rng, depth - 1))


def postfix(t):
    return [t] if isinstance(t, int) else [x for part in t[1:] for x in postfix(part)] + [{"o": -1, "d": -2, "t": -3}[t[0]]]


def at(t, path):
    for way in path:
        if isinstance(t, int):
            return None
        t = t[1] if t[0] == "t" or way == 0 else t[2]
    return t


def put(t, path, new):
    if not path:
        return new
    if isinstance(t, int):
        return None
    i = 1 if t[0] == "t" or path[0] == 0 else 2
    inner = put(t[i], path[1:], new)
    return None if inner is None else (*t[:i], inner, *t[i + 1 :])


def redex(t):
    """The path to the innermost leftmost operator."""
    if isinstance(t, int):
        return None
    for way, part in enumerate(t[1:]):
        if (found := redex(part)) is not None:
            return [way, *found]
    return []


def paths(t, path=()):
    return [path] + ([] if isinstance(t, int) else [p for i, part in enumerate(t[1:]) for p in paths(part, (*path, i))])


def test_every_path_of_random_trees(spark):
    rng = random.Random(11)
    trees = [0, ("t", 1), ("o", 1, 2)] + [tree(rng, 6) for _ in range(60)]
    cases = [(i, list(p)) for i, t in enumerate(trees) for p in [*paths(t)[:40], (0,) * 9, (1,) * 3, *itertools.product((0, 1), repeat=2)]]
    rows = spark.createDataFrame([(i, p, postfix(trees[i])) for i, p in cases], "i int, path array<int>, rpn array<int>").withColumn("a", ex.compile_system(F.expr(SYSTEM)))
    a, rpn = F.col("a"), F.col("rpn")
    new = F.array(F.lit(0), F.lit(-3), F.lit(2), F.lit(-1))
    got = rows.select("i", "path", ex.get_at(rpn, F.col("path"), a).alias("part"), ex.replace_at(rpn, F.col("path"), new, a).alias("put"), ex.path_to(rpn, ex.place_at(rpn, F.col("path"), a), a).alias("back"), ex.redex_path(rpn, a).alias("next")).collect()
    assert len(got) == len(cases)
    for r in got:
        t = trees[r.i]
        part, replaced = at(t, r.path), put(t, tuple(r.path), ("o", ("t", 0), 2))
        assert r.part == (None if part is None else postfix(part))
        assert r.put == (None if replaced is None else postfix(replaced))
        assert r.next == redex(t)
        # The way back is the same node's, with way 0 below transforms.
        assert (r.back is None) == (part is None)
        if part is not None:
            assert len(r.back) == len(r.path) and at(t, r.back) == part


@pytest.mark.parametrize("rpn, path", [([], []), ([0], [0]), (None, [0]), ([0, 1, -1], None)])
def test_nothing_there(spark, rpn, path):
    """An empty expression, a way below a symbol, nulls: null."""
    row = spark.createDataFrame([(rpn, path)], "rpn array<int>, path array<int>").withColumn("a", ex.compile_system(F.expr(SYSTEM)))
    args = F.col("rpn"), F.col("path"), F.col("a")
    assert row.select(ex.get_at(*args)).first()[0] is None
    assert row.select(ex.replace_at(args[0], args[1], F.array(F.lit(1)), args[2])).first()[0] is None


def test_numbers_that_are_no_places(spark):
    row = spark.range(1).select(F.array(F.lit(0), F.lit(1), F.lit(-1)).alias("rpn"), ex.compile_system(F.expr(SYSTEM)).alias("a"))
    got = row.select(*[ex.path_to(F.col("rpn"), F.lit(p), F.col("a")).alias(f"p{p}") for p in (0, 1, 2, 3, 4)]).first()
    assert list(got) == [None, [0], [1], [], None]
