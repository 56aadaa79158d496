"""Classes of expressions against stated ones."""

import pytest

from lorewright.operators import expressions


def grouped(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["class"], set()).add(r["id"])
    return sorted(map(sorted, by.values()))


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, expression string")


def test_order_of_sums_and_products(spark):
    e = frame(spark, "a*x + b", "b + x*a", "(b + a*x)", "a*(x + b)", "(b+x)*a", "a - b", "-b + a", "b - a", "a/b", "a*b**-1", "b/a", "a + (b + c)", "(c + a) + b", "sin(a + b)", "sin(b + a)", "cos(a + b)", "2", "2.0", "x**2", "x^2", "2**x")
    assert grouped(expressions.classes(e)) == [[0, 1, 2], [3, 4], [5, 6], [7], [8, 9], [10], [11, 12], [13, 14], [15], [16, 17], [18, 19], [20]]


def test_names(spark):
    e = frame(spark, "a*x + b", "k + m*n", "a*x + a", "p**q", "q**p", "p**p", "sin(x) + y", "t + sin(z)", "x + 1", "y + 2")
    assert grouped(expressions.classes(e, names=False)) == [[0, 1], [2], [3, 4], [5], [6, 7], [8], [9]]
    assert grouped(expressions.classes(e)) == [[i] for i in range(10)]


def test_equalities_reach_inside(spark):
    e = frame(spark, "f(a)", "f(b)", "f(c)", "g(f(a), x)", "g(f(b), x)", "g(x, f(b))", "a + 1", "1 + b", "f(f(a))", "f(f(c))", "a")
    known = spark.createDataFrame([("a", "b"), ("f(b)", "f(c)"), ("bad (", "a"), (None, "a")], "lhs string, rhs string")
    assert grouped(expressions.classes(e, known)) == [[0, 1, 2], [3, 4], [5], [6, 7], [8, 9], [10]]
    # f(f(f(a))) = a and f(a) = a by way of five steps and three
    e = frame(spark, "a", "f(a)", "f(f(a))", "b")
    loops = spark.createDataFrame([("f(f(f(a)))", "a"), ("f(f(f(f(f(a)))))", "a")], "lhs string, rhs string")
    assert grouped(expressions.classes(e, loops)) == [[0, 1, 2], [3]]


def test_what_is_no_expression(spark):
    e = frame(spark, "x +", "", None, "import os", "f(x=1)", "'s'", "a.b", "x if y else z", "True", "ok", "(" * 500 + "x" + ")" * 500)
    assert [r["id"] for r in expressions.classes(e).collect()] == [9]
    assert expressions.classes(e.limit(0)).count() == 0
    with pytest.raises(ValueError, match="names"):
        expressions.classes(e, spark.createDataFrame([], "lhs string, rhs string"), names=False)
    assert grouped(expressions.classes(frame(spark, "a", "b"), spark.createDataFrame([], "lhs string, rhs string"))) == [[0], [1]]
