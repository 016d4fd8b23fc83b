"""Key checks: set differences with NULL keys ignored."""

from matchmart.operators.integrity import key_check, missing_keys, with_children


def test_key_check_and_missing_keys_ignore_nulls(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,), (5,)], "k long")
    parent = spark.createDataFrame([(1,), (3,), (None,)], "k long")
    r = key_check("c", child, parent, ["k"]).first()
    assert (r.check, r.child_keys, r.parent_keys, r.missing) == ("c", 3, 2, 2)
    assert sorted(x.k for x in missing_keys(child, parent, ["k"]).collect()) == [2, 5]


def test_composite_keys_and_semi_filter(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "m long, s int")
    b = spark.createDataFrame([(1, 1), (2, 0)], "m long, s int")
    assert [tuple(x) for x in missing_keys(a, b, ["m", "s"]).collect()] == [(1, 0)]
    parents = spark.createDataFrame([(1, "x"), (3, "y")], "m long, v string")
    assert [x.m for x in with_children(parents, a, "m").collect()] == [1]
