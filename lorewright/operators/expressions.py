"""Expressions as trees in tables: equal up to the order of sums and products, up to names, and under known equalities.

An expression becomes rows, one a node. From the leaves upwards a node's key is the digest of its
operation and its operands' keys, those of sums and products in order of the keys, so equal
subtrees of all expressions share one key and one row. Known equalities join keys, and where the
operands of two nodes have become equal, the nodes do too, round by round until nothing changes.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.operators import graph
from lorewright.operators.lineage import cut

NODE = "node int, parent int, place int, height int, op string"
#: Operations whose operands have no order.
COMMUTATIVE = ("add", "mul")
_BINARY = {ast.Add: "add", ast.Mult: "mul", ast.Pow: "pow"}


def tree_rows(expression: str) -> list[tuple[int, int, int, int, str]] | None:
    """(node, parent, place, height, op) of an expression, the root first; null where it is none.

    a - b is a + (-1) * b, a / b is a * b ** -1; sums of sums and products of products are one
    node. Leaves are `name:x` and `number:2`, calls `call:f`.
    """
    try:
        root = ast.parse(expression.replace("^", "**").strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None

    def parts(n: ast.AST) -> tuple[str, list]:
        minus = lambda x: (f"number:{-float(x[0][7:]):g}", []) if x[0].startswith("number:") else joined("mul", [("number:-1", []), x])
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Sub):
            return joined("add", [parts(n.left), minus(parts(n.right))])
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Div):
            return joined("mul", [parts(n.left), ("pow", [parts(n.right), ("number:-1", [])])])
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return joined(_BINARY[type(n.op)], [parts(n.left), parts(n.right)])
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return minus(parts(n.operand))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd):
            return parts(n.operand)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            return f"call:{n.func.id}", [parts(a) for a in n.args]
        if isinstance(n, ast.Name):
            return f"name:{n.id}", []
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return f"number:{n.value:g}", []
        raise ValueError(type(n).__name__)

    def joined(op: str, operands: list) -> tuple[str, list]:
        flat = [y for x in operands for y in (x[1] if op in COMMUTATIVE and x[0] == op else [x])]
        return op, flat

    rows: list[tuple[int, int, int, int, str]] = []

    def add(tree: tuple[str, list], parent: int, place: int) -> int:
        at = len(rows)
        rows.append((at, parent, place, 0, tree[0]))
        height = 1 + max([add(x, at, i) for i, x in enumerate(tree[1])], default=-1)
        rows[at] = (at, parent, place, height, tree[0])
        return height

    try:
        add(parts(root), -1, 0)
    except (ValueError, RecursionError):
        return None
    return rows


def nodes(expressions: DataFrame) -> DataFrame:
    """(id, expression) -> (id, node, parent, place, height, op); what is no arithmetic expression has no nodes."""
    kind = dict(expressions.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, e in zip(b["id"], b["expression"], strict=True) for r in (tree_rows(e) or [] if isinstance(e, str) else [])]
            yield pd.DataFrame(rows, columns=["id", "node", "parent", "place", "height", "op"])

    return expressions.select("id", "expression").mapInPandas(run, f"id {kind}, {NODE}")


def signature(op: Column, operands: Column) -> Column:
    """The digest of an operation and its operands' keys, which are in order."""
    return F.sha2(F.concat_ws("|", op, F.array_join(operands, "|")), 256)


def ordered(op: Column, operands: Column) -> Column:
    """(place, key) operands as keys: sorted for commutative operations, else by place."""
    return F.when(op.isin(*COMMUTATIVE), F.array_sort(F.transform(operands, lambda x: x["key"]))).otherwise(F.transform(F.array_sort(operands), lambda x: x["key"]))


def keyed(tree: DataFrame, *, leaf: Column | None = None) -> DataFrame:
    """Nodes with `operands` (keys) and `key`, level by level from the leaves. `leaf`: what a leaf's operation counts as."""
    tree = cut(tree)
    op = F.col("op") if leaf is None else F.when(F.col("height") == 0, leaf).otherwise(F.col("op"))
    done = tree.where("height = 0").withColumn("operands", F.array().cast("array<string>")).withColumn("key", signature(op, F.col("operands")))
    for h in range(1, (tree.agg(F.max("height")).first()[0] or 0) + 1):
        below = done.select("id", F.col("parent").alias("node"), F.struct("place", "key").alias("o"))
        level = tree.where(F.col("height") == h).join(below, ["id", "node"]).groupBy("id", "node", "parent", "place", "height", "op").agg(F.collect_list("o").alias("o"))
        level = level.withColumn("operands", ordered(F.col("op"), F.col("o"))).drop("o").withColumn("key", signature(F.col("op"), F.col("operands")))
        done = cut(done.unionByName(level))
    return done


def renamed(tree: DataFrame) -> DataFrame:
    """Nodes whose variables are called v1, v2, ... by their first place, operands of sums and products being in the order of their shapes.

    So expressions that differ by names alone get equal keys, unless operands of one shape leave
    the order of their names open: those stay in the order given.
    """
    shape = keyed(tree, leaf=F.when(F.col("op").startswith("name:"), F.lit("name")).otherwise(F.col("op")))
    # a node's way from the root, operands in the order of their shapes
    nth = F.row_number().over(graph.Window.partitionBy("id", "parent").orderBy(F.when(F.col("_free"), F.col("key")), "place"))
    up = shape.select("id", F.col("node").alias("parent"), F.col("op").isin(*COMMUTATIVE).alias("_free"))
    step = cut(shape.join(up, ["id", "parent"], "left").withColumn("nth", nth).select("id", "node", "parent", "place", "height", "op", "nth"))
    way = step.where("parent = -1").select("id", "node", F.array(F.lit(0)).alias("way"))
    every = way
    for _ in range(shape.agg(F.max("height")).first()[0] or 0):
        way = cut(step.select("id", "node", "parent", "nth").join(way.select("id", F.col("node").alias("parent"), "way"), ["id", "parent"]).select("id", "node", F.concat("way", F.array("nth")).alias("way")))
        every = every.unionByName(way)
    names = step.where("op like 'name:%'").join(every, ["id", "node"]).groupBy("id", "op").agg(F.min("way").alias("way"))
    names = names.withColumn("to", F.concat(F.lit("name:v"), F.row_number().over(graph.Window.partitionBy("id").orderBy("way")).cast("string"))).select("id", "op", "to")
    return tree.join(names, ["id", "op"], "left").withColumn("op", F.coalesce("to", "op")).drop("to")


def classes(expressions: DataFrame, equalities: DataFrame | None = None, *, names: bool = True) -> DataFrame:
    """(id, expression) -> (id, class): expressions of one class are equal up to the order of sums and products, up to their names unless `names` count, and under `equalities` (lhs, rhs) of verified relations.

    A class is the smallest key that it holds, 64 hexadecimal digits. Equalities hold of the
    expressions as they are written, also inside others, and are given with `names` only. id must be
    unique; what is no arithmetic expression has no row.
    """
    if equalities is not None and not names:
        raise ValueError("equalities hold between names as they are")
    own = nodes(expressions.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), "expression"))
    tree = own if names else renamed(own)
    if equalities is not None:
        e = cut(equalities.select(F.monotonically_increasing_id().cast("string").alias("n"), "lhs", "rhs"))
        sides = [e.select(F.concat(F.lit(s), "n").alias("id"), F.col(c).alias("expression")) for s, c in (("l", "lhs"), ("r", "rhs"))]
        tree = tree.unionByName(nodes(sides[0])).unionByName(nodes(sides[1]))
    done = cut(keyed(tree))
    roots = done.where("parent = -1").select("id", "key")
    kinds = {"id": dict(expressions.dtypes)["id"]}
    mine = lambda r: r.where("id like 'e%'").select(F.substring("id", 2, 1 << 20).cast(kinds["id"]).alias("id"), F.col("key").alias("class"))
    if equalities is None:
        return mine(roots)
    shared = cut(done.select("key", "op", "operands").distinct())
    side = lambda s: roots.where(F.col("id").startswith(s)).select(F.substring("id", 2, 1 << 20).alias("n"), F.col("key").alias(s))
    equal = cut(side("l").join(side("r"), "n").where("l != r").select(F.col("l").alias("src"), F.col("r").alias("dst")))
    while True:
        known = equal.select(F.col("src").alias("node")).unionByName(equal.select(F.col("dst").alias("node"))).distinct()
        reps = cut(graph.components(known, equal.withColumn("relation", F.lit("="))))
        # signatures under the classes so far; operands of no known class are their own
        flat = shared.select("key", "op", F.posexplode("operands").alias("place", "x")).join(reps.select(F.col("node").alias("x"), "component"), "x", "left")
        now = flat.groupBy("key", "op").agg(F.collect_list(F.struct("place", F.coalesce("component", "x").alias("key"))).alias("o")).withColumn("signature", signature(F.col("op"), ordered(F.col("op"), F.col("o"))))
        now = now.join(reps.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("rep", F.coalesce("component", "key"))
        least = now.groupBy("signature").agg(F.min("rep").alias("least"))
        new = cut(now.join(least, "signature").where("rep != least").select(F.col("rep").alias("src"), F.col("least").alias("dst")).distinct())
        if new.isEmpty():
            break
        equal = cut(equal.unionByName(new).distinct())
    out = roots.join(reps.withColumnRenamed("node", "key"), "key", "left").select("id", F.coalesce("component", "key").alias("key"))
    return mine(out)
