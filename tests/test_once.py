"""Work that many rows share is done once for each distinct value."""

import pytest
from derivanta.operators.once import once_each
from derivanta.plans import queries, shapes
from derivanta.sources.scratch import Scratch
from pyspark.sql import functions as F


def test_nulls_arrays_and_repeats(spark):
    data = [(i, k, t) for i, (k, t) in enumerate([([1, None], "x"), ([1, None], None), (None, None), ([], ""), ([1], "x")] * 20)]
    rows = spark.createDataFrame(data, "i int, k array<int>, t string")
    given = []

    def work(d):
        given.append(d.count())
        return d.withColumn("n", F.size("k")).withColumn("u", F.concat("t", F.lit("!")))

    for threshold in ("10m", "-1"):  # a broadcast, then a shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = once_each(rows, ["k", "t"], work, Scratch(spark, "once")).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted((r.i, r.k, r.t, r.n, r.u) for r in got) == [(i, k, t, None if k is None else len(k), None if t is None else t + "!") for i, k, t in data]
    assert given == [5, 5]


def repeated(spark, tmp_path):
    """A folder whose lineitem holds 400 times the same 3 rows, one with nulls."""
    rows = spark.createDataFrame([(7, 3, 1, 11), (8, 4, 2, 12), (9, None, None, 13)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    rows.crossJoin(spark.range(400)).drop("id").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["step_verdicts", "injected_prefills", "clean_derivations", "reduction_steps", "subtree_paths"])
def test_rows_that_share_a_value(spark, tmp_path, monkeypatch, name):
    given = []

    def counted(rows, keys, work, scratch):
        return once_each(rows, keys, lambda d: given.append(d.count()) or work(d), scratch)

    for module in (queries, shapes):
        if hasattr(module, "once_each"):
            monkeypatch.setattr(module, "once_each", counted)
    got = queries.QUERIES[name](spark, repeated(spark, tmp_path))
    assert got.count() % 1200 == 0 and got.count() > 0
    assert given == [3]


def test_shapes_stand_for_their_rows(spark):
    """Trees and paths made of remainders are those of the keys, below 0 and null ones too."""
    keys = [0, 1, 4, 13, 19999, -1, -7, -12, None]
    rows = spark.createDataFrame([(o, n, p, s) for o in keys for p in keys for s in keys for n in (1, 4, 7)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    own = rows.select(F.struct(*shapes.IDS).alias("shape"))
    made = []
    for d in (own, shapes.shape_of(rows).select("shape")):
        made.append(sorted(map(repr, shapes._trees(d).select("rpn", "path").collect())))
    assert made[0] == made[1] and len(made[0]) == 27 * 81


def test_steps_of_each_shape_once(spark, tmp_path):
    """800 rows of 2 shapes: the expressions are made and counted after the grouping."""
    rows, system = queries._shaped(spark, repeated(spark, tmp_path))
    rows = rows.where("l_partkey is not null")
    counted = shapes._counted(rows, system)
    assert sorted(r.n for r in counted.select("n").collect()) == [400] * 2
    assert sum(r.n for r in shapes.eligible_error_steps(rows, system).collect()) == 800
