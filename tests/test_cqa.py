import itertools
import random

import pytest

from naive import evaluate, repairs
from stratavane.cqa import NotRewritable, attack_graph, queries_of, to_dot
from stratavane.engine import Engine
from stratavane.plans.parser import parse

INPUTS = "EDB_DECL:\nR([x] int, y int)\nS([y] int, z int)\nT([z] int, u int)\nIDB_DECL:\n"


def text(head, rule):
    return f"{INPUTS}{head}\nRULE_DECL:\n{rule}"


def frames(spark, tables):
    return {k: spark.createDataFrame(sorted(v), "a int, b int") if v else spark.createDataFrame([], "a int, b int") for k, v in tables.items()}


def truth(program, tables):
    answers = None
    for chosen in itertools.product(*(repairs(tables[k], [0]) for k in "RST")):
        found = evaluate(program, dict(zip("RST", chosen)))["Q"]
        answers = found if answers is None else answers & found
    return answers


SHAPES = [
    ("Q(x int)", "Q(x) :- R(x, y), S(y, z)."),
    ("Q(x int)", "Q(x) :- R(x, y), S(y, 2)."),
    ("Q(x int)", "Q(x) :- R(x, 1)."),
    ("Q(x int)", "Q(x) :- R(x, x)."),
    ("Q(x int, z int)", "Q(x, z) :- R(x, y), S(y, z)."),
    ("Q(x int)", "Q(x) :- R(x, y), S(y, z), T(z, _)."),
    ("Q(x int)", "Q(x) :- R(x, y), S(y, x)."),
    ("Q()", "Q() :- R(x, y), S(y, z)."),
    ("Q()", "Q() :- R(1, y), S(y, _)."),
    ("Q(y int)", "Q(y) :- R(_, y), S(y, _)."),
    ("Q(y int)", "Q(y) :- R(x, y), S(2, z), T(z, x)."),
    ("Q(x int)", "Q(x) :- R(x, y), T(x, u)."),
    ("Q(x int, u int)", "Q(x, u) :- R(x, 1), T(x, u)."),
    ("Q(x int)", "Q(x) :- R(x, y), S(y, z), T(x, 1)."),
    ("Q(x int, z int)", "Q(x, z) :- R(x, 1), T(z, u)."),
    ("Q(x int)", "Q(x) :- R(x, y), S(y, 0), T(z, 2)."),
    ("Q()", "Q() :- R(x, 1), T(x, 2)."),
]
TREES = {"Q(x) :- R(x, y), T(x, u).", "Q(x, u) :- R(x, 1), T(x, u).", "Q(x) :- R(x, y), S(y, z), T(x, 1).", "Q(x, z) :- R(x, 1), T(z, u).", "Q(x) :- R(x, y), S(y, 0), T(z, 2)."}


@pytest.mark.parametrize(("head", "rule"), SHAPES)
def test_certain_answers_are_those_of_all_repairs(spark, head, rule):
    program = parse(text(head, rule))
    rng = random.Random(rule)
    seen = set()
    for _ in range(3):
        tables = {k: {(rng.randrange(3), rng.randrange(3)) for _ in range(rng.randrange(1, 6))} for k in "RST"}
        want = truth(program, tables)
        got = Engine(spark).certain(program, frames(spark, tables))
        if head == "Q()":
            assert [tuple(r) for r in got.collect()] == [(True,)] * bool(want)
        else:
            assert {tuple(r) for r in got.collect()} == want
        try:
            tree = Engine(spark).certain(program, frames(spark, tables), "join_graph")
            seen.add("tree")
            rows = {tuple(r) for r in tree.collect()}
            assert rows == ({(True,)} if want else set()) if head == "Q()" else rows == want
        except NotRewritable:
            seen.add("no tree")
    assert seen and (rule not in TREES or seen == {"tree"})


def test_cyclic_attacks_are_rejected(spark):
    with pytest.raises(NotRewritable, match="cyclic"):
        Engine(spark).certain(text("Q()", "Q() :- R(x, y), S(y, x)."), frames(spark, {k: {(1, 1)} for k in "RST"}))


@pytest.mark.parametrize(
    ("rule", "message"),
    [("Q(x) :- R(x, y), R(y, _).", "self-join"), ("Q(x) :- R(x, y), x > 1.", "only atoms"), ("Q(COUNT(x)) :- R(x, y).", "only atoms")],
)
def test_other_queries_are_rejected(spark, rule, message):
    with pytest.raises(NotRewritable, match=message):
        queries_of(parse(text("Q(x int)", rule)))


def test_attack_graph_as_text():
    q = queries_of(parse(text("Q()", "Q() :- R(x, y), S(y, z).")))[0]
    assert attack_graph(q) == {"R": {"S"}, "S": set()}
    assert '"R" -> "S"' in to_dot(attack_graph(q))


@pytest.mark.parametrize("method", ["attack_graph", "join_graph"])
def test_products_come_last(spark, method):
    """Parts that no variable connects are answered apart; nothing groups, joins or stores their combinations."""
    program = parse(text("Q(x int, z int)", "Q(x, z) :- R(x, y), S(y, _), T(z, 2)."))
    tables = {"R": {(1, 1), (2, 1), (2, 5), (3, 1)}, "S": {(1, 4)}, "T": {(6, 2), (7, 2), (7, 3), (8, 2)}}
    got = Engine(spark).certain(program, frames(spark, tables), method)
    assert {tuple(r) for r in got.collect()} == truth(program, tables) == {(x, z) for x in (1, 3) for z in (6, 8)}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    product = next(i for i, line in enumerate(plan) if "Join Cross" in line or "Join Inner" in line and "=" not in line)
    assert not [line for line in plan[:product] if "Aggregate" in line or "Join" in line]
