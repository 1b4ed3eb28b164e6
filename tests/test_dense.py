import random

import pytest

from naive import evaluate
from stratavane.engine import Engine
from stratavane.plans import dense, fixpoint
from stratavane.plans.analysis import stratify
from stratavane.plans.parser import parse
from stratavane.queries import PROGRAMS

CSPA = PROGRAMS["r6_cspa"]
LOOPS = """EDB_DECL:
Arc(x int, y long)
IDB_DECL:
Near(x long, y int)
Self(x int, y int)
RULE_DECL:
Near(x, y) :- Arc(x, y).
Near(x, y) :- Near(x, z), Near(z, y), Arc(z, z), Near(_, x).
Near(x, y) :- Self(x, x), Arc(y, x).
Self(y, y) :- Near(x, y), Arc(y, _)."""


def pairs(rng, n, groups, size):
    out = set()
    for _ in range(n):
        g = rng.randrange(groups) * size * 3
        out.add((g + rng.randrange(size), g + rng.randrange(size)))
    return sorted(out)


def solved(spark, text, edb, names):
    frames = {n: spark.createDataFrame(rows, "x int, y int") for n, rows in edb.items()}
    result = Engine(spark).run(text, frames)
    return {n: sorted(tuple(r) for r in result[n].collect()) for n in names}


@pytest.mark.parametrize("nodes,edges,chunk", [(64, 1024, 1 << 19), (5, 1024, 1 << 19), (64, 9, 7)])
def test_small_and_large_components_agree_with_a_naive_evaluator(spark, monkeypatch, nodes, edges, chunk):
    monkeypatch.setattr(dense, "NODES", nodes)
    monkeypatch.setattr(dense, "EDGES", edges)
    monkeypatch.setattr(dense, "_CHUNK", chunk)
    rng = random.Random(nodes + edges)
    edb = {"Assign": pairs(rng, 25, 6, 4) + [(1000, 1000)], "Deref": pairs(rng, 25, 6, 4) + [(7, 2000)]}
    want = evaluate(parse(CSPA), {k: set(v) for k, v in edb.items()})
    assert solved(spark, CSPA, edb, ["P"])["P"] == sorted(want["P"])


def test_loops_wildcards_and_types(spark):
    edb = {"Arc": pairs(random.Random(3), 60, 8, 5)}
    want = evaluate(parse(LOOPS), {"Arc": set(edb["Arc"])})
    assert solved(spark, LOOPS, edb, ["Near", "Self"]) == {n: sorted(want[n]) for n in ("Near", "Self")}


def test_no_rows(spark):
    assert solved(spark, CSPA, {"Assign": [], "Deref": []}, ["P"])["P"] == []


def test_small_components_need_no_iteration(spark, monkeypatch):
    monkeypatch.setattr(fixpoint.Evaluator, "recursive", None)
    assert solved(spark, CSPA, {"Assign": [(1, 2)], "Deref": [(2, 3)]}, ["P"])["P"]


def test_rules_that_reach_across_components_do_not_fit():
    for name, want in (("r6_cspa", True), ("r4_andersen", True), ("r4_tc_nonlinear", True), ("r1_tc", False), ("r7_cc", False), ("r6_mutual", False)):
        program = parse(PROGRAMS[name])
        assert any(s.recursive and dense.fits(program, s) for s in stratify(program)) == want
    apart = parse("EDB_DECL:\nA(x int, y int)\nIDB_DECL:\nT(x int, y int)\nRULE_DECL:\nT(x, y) :- A(x, y).\nT(x, y) :- T(x, a), T(b, y).")
    assert not any(dense.fits(apart, s) for s in stratify(apart))


def test_copies_under_one_constant_are_made_distinct(spark):
    text = CSPA.replace("P(2, x, y)", "P(1, x, y)")
    edb = {"Assign": [(1, 2), (2, 3)], "Deref": [(2, 3), (3, 1)]}
    assert solved(spark, text, edb, ["P"])["P"] == sorted(evaluate(parse(text), {k: set(v) for k, v in edb.items()})["P"])


def test_chunks_share_few_values(spark, monkeypatch):
    monkeypatch.setattr(fixpoint.Evaluator, "recursive", None)
    monkeypatch.setattr(dense, "_CHUNK", 50)
    monkeypatch.setattr(dense, "LINKS", 60)
    rows = [(10 * i, 10 * i + 1 + k) for k in range(4) for i in range(250)]
    assert len(solved(spark, CSPA, {"Assign": rows, "Deref": []}, ["P"])["P"]) > 3 * len(rows)
