import random

import pytest

from naive import evaluate
from stratavane.config import EngineConfig
from stratavane.engine import Engine
from stratavane.plans.ast import ProgramError
from stratavane.plans.parser import parse
from stratavane.queries import program as text_of


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def run(spark, text, edb, name, **config):
    return sorted(tuple(r) for r in Engine(spark, EngineConfig(**config)).run(text, edb)[name].collect())


def declare(inputs, derived, rules):
    return "EDB_DECL:\n" + "\n".join(inputs) + "\nIDB_DECL:\n" + "\n".join(derived) + "\nRULE_DECL:\n" + rules


ARC = ["Arc(x int, y int)"]
WEIGHTED = ["Arc(x int, y int, z int)"]
TC = declare(ARC, ["Tc(x int, y int)"], "Tc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, w), Arc(w, y).")


def chain(spark):
    return frame(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], "x int, y int")


def test_transitive_closure(spark):
    assert run(spark, TC, {"Arc": chain(spark)}, "Tc") == [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]


@pytest.mark.parametrize("how", ["one_phase", "two_phase"])
def test_set_difference_kinds_agree_on_a_cycle(spark, how):
    arc = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], "x int, y int")
    assert run(spark, TC, {"Arc": arc}, "Tc", set_difference=how) == sorted((i, j) for i in (1, 2, 3) for j in (1, 2, 3, 4))


def test_snapshot_of_a_relation_that_pauses(spark):
    text = declare(["A(x int)", "E(x int, y int)", "F(x int, y int)", "G(x int, y int, z int)"], ["X(x int)", "Y(x int)"], "Y(x) :- A(x).\nX(y) :- Y(x), F(x, y).\nY(y) :- Y(x), E(x, y).\nY(z) :- X(x), Y(y), G(x, y, z).")
    edb = {"A": frame(spark, [(1,)], "x int"), "E": frame(spark, [(1, 2), (2, 3), (3, 4)], "x int, y int"), "F": frame(spark, [(1, 10)], "x int, y int"), "G": frame(spark, [(10, 4, 20)], "x int, y int, z int")}
    got = Engine(spark).run(text, edb)
    assert sorted(r[0] for r in got["X"].collect()) == [10]
    assert sorted(r[0] for r in got["Y"].collect()) == [1, 2, 3, 4, 20]


def test_recursive_minimum(spark):
    text = declare(WEIGHTED, ["D(x int, y int)", "S(x int, y int)"], "D(1, 0) :-.\nD(y, MIN(d1 + d2)) :- D(x, d1), Arc(x, y, d2).\nS(x, MIN(d)) :- D(x, d).")
    arc = frame(spark, [(1, 2, 5), (2, 3, 1), (1, 3, 10), (3, 1, 1)], "x int, y int, z int")
    assert run(spark, text, {"Arc": arc}, "S") == [(1, 0), (2, 5), (3, 6)]


def test_expressions_in_body_atoms(spark):
    text = declare(["price(day int, p int)"], ["rise(day int, by int)", "best(day int, by int)"], "rise(d, q - p) :- price(d, q), price(d-1, p), q > p.\nbest(d + 1, MAX(r)) :- rise(d, r), rise(d - 1, _), 2 <= d.")
    assert run(spark, text, {"price": frame(spark, [(1, 5), (2, 9), (3, 10), (4, 4)], "day int, p int")}, "best") == [(4, 1)]


def test_empty_inputs(spark):
    empty = frame(spark, [], "x int, y int")
    text = declare(ARC, ["N(x long)", "P(x int)", "Tc(x int, y int)"], "N(COUNT(x)) :- Arc(x, _).\nP(7) :- Arc(_, _).\nP(8) :- !Arc(_, _).\nTc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, w), Tc(w, y).")
    got = Engine(spark).run(text, {"Arc": empty})
    assert got["N"].collect() == [] and got["Tc"].collect() == []
    assert [r[0] for r in got["P"].collect()] == [8]


def test_divergence_is_stopped(spark):
    text = declare(WEIGHTED, ["P(x int, y int, w int)"], "P(x, y, w) :- Arc(x, y, w).\nP(x, y, a + b) :- P(x, z, a), Arc(z, y, b).")
    arc = frame(spark, [(1, 1, 1)], "x int, y int, z int")
    with pytest.raises(ProgramError, match="didn't settle in 3"):
        run(spark, text, {"Arc": arc}, "P", max_iterations=3)
    assert run(spark, text, {"Arc": arc}, "P", stop_after=2) == [(1, 1, 1), (1, 1, 2), (1, 1, 3)]


def test_bags_and_flags(spark):
    two = frame(spark, [(1, 2), (1, 3)], "x int, y int")
    text = declare(ARC, ["P(x int)"], "P(x) :- Arc(x, _).")
    assert run(spark, text, {"Arc": two}, "P") == [(1,)]
    assert run(spark, text, {"Arc": two}, "P", selective_dedup=True) == [(1,), (1,)]
    assert run(spark, text, {"Arc": two}, "P", selective_dedup=True, dedup_relation_list=["P"]) == [(1,)]
    assert run(spark, text.replace("_).", "_) [!dedup]."), {"Arc": two}, "P") == [(1,), (1,)]


def test_integer_division_truncates(spark):
    text = declare(ARC, ["P(x int, y int)"], "P(x, x / y) :- Arc(x, y).")
    assert run(spark, text, {"Arc": frame(spark, [(7, 2), (-7, 2)], "x int, y int")}, "P") == [(-7, -3), (7, 3)]


def test_views_metrics_and_explain(spark):
    engine = Engine(spark)
    result = engine.run(TC, {"Arc": chain(spark)})
    assert engine.sql("SELECT count(*) FROM Tc").first()[0] == 10
    assert [m.new["Tc"] for m in result.metrics] == [3, 2, 1, 0] and result.metrics[-1].total["Tc"] == 10
    assert "(recursive)" in engine.explain(TC)
    engine.close()


def test_inputs_are_checked(spark):
    with pytest.raises(ProgramError, match="no data for Arc"):
        Engine(spark).run(TC)
    with pytest.raises(ProgramError, match="not inputs"):
        Engine(spark).run(TC, {"Arc": chain(spark), "X": chain(spark)})


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "Arc.csv").write_text("1, 2\n2, 3\n")
    config = EngineConfig(input_dir=str(tmp_path), write_to_csv=True, output_dir=str(tmp_path / "out"), final_output_relations=["Tc"], retain_final_output_only=True)
    assert sorted(tuple(r) for r in Engine(spark, config).run(TC)["Tc"].collect()) == [(1, 2), (1, 3), (2, 3)]
    assert spark.read.csv(str(tmp_path / "out" / "Tc.csv")).count() == 3
    with pytest.raises(ProgramError, match="no input"):
        Engine(spark, EngineConfig(input_dir=str(tmp_path))).run(TC.replace("Arc", "Ark"))


def test_preloaded_tables(spark):
    chain(spark).createOrReplaceTempView("Arc")
    assert len(run(spark, TC, {}, "Tc", preload=True)) == 10
    spark.catalog.dropTempView("Arc")


RULES = [
    "P(x, y) :- E(x, y).\nP(x, y) :- P(x, z), P(z, y).",
    "P(x, y) :- E(x, y).\nP(x, y) :- Q(x), E(x, y).\nQ(x) :- P(_, x), F(x, _).",
    "P(x, MIN(y)) :- E(x, y).\nP(y, MIN(w)) :- P(x, w), E(x, y).\nQ(x) :- P(x, y), y < 3.",
    "P(x, y) :- E(x, z), F(z, y), x != y, !F(x, y).\nQ(x) :- E(x, _), !P(x, _).",
    "P(x, SUM(z)) :- E(x, y), F(y, z).\nQ(COUNT(x)) :- P(x, y), y >= 2.",
    "P(x, w) :- E(x, y), w = x * 2 + y, F(w - y, _).\nQ(x) :- F(x, x).\nQ(9) :-.",
]


@pytest.mark.parametrize("rules", RULES)
def test_against_a_naive_evaluator(spark, rules):
    text = declare(["E(x int, y int)", "F(x int, y int)"], ["P(x int, y int)", "Q(x int)"], rules)
    rng = random.Random(len(rules))
    for n in (4, 14):
        tables = {k: {(rng.randrange(6), rng.randrange(6)) for _ in range(n)} for k in ("E", "F")}
        want = evaluate(parse(text), tables)
        got = Engine(spark).run(text, {k: frame(spark, sorted(v), "x int, y int") for k, v in tables.items()})
        for name in ("P", "Q"):
            rows = [tuple(r) for r in got[name].collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want[name], (name, tables)


def test_program_texts_of_the_queries_parse():
    from stratavane.queries import ORACLES, PROGRAMS, QUERIES

    for text in PROGRAMS.values():
        program = parse(text)
        assert parse(str(program)) == program
    assert set(QUERIES) == set(ORACLES) and text_of is not None


def test_graphs_and_pointer_relations_hold_all_rows(spark, tmp_path):
    from stratavane.queries import inputs

    orders = [(k, k % 4, f"{k % 5 + 1}-X", "FOP"[k % 3]) for k in range(1, 41)]
    lines = [(k, k % 6, n, 1.0 * n * k, "ANR"[k % 3]) for k in range(1, 41) for n in range(1, 8)]
    tables = {
        "customer": spark.range(7), "part": spark.range(6),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    pointers = ["Assign", "Deref", "Load", "Store", "AddressOf"]
    got = {n: sorted(map(tuple, df.collect())) for n, df in inputs(spark, str(tmp_path), ["Arc", "ArcW", *pointers]).items()}
    arcs = [(k - k % 32 + k % 32 * (p % 32) // 32, k, (k + p) % 17 + 1) for k, p, *_ in lines]
    assert got["Arc"] == sorted({(x, y) for x, y, _ in arcs})
    assert got["ArcW"] == sorted((x, y, min(w for a, b, w in arcs if (a, b) == (x, y))) for x, y in got["Arc"])
    for i, name in enumerate(pointers):
        assert got[name] == sorted({(k, k - k % 8 + p % 8) for k, p, n, *_ in lines if n % 5 == (i + 1) % 5})


def _cycle(spark, n=40):
    return {"Arc": spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(i, (7 * i) % n) for i in range(n)], "x int, y int")}


@pytest.mark.parametrize("rules", ["Tc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, z), Arc(z, y).", "Tc(x, MIN(x)) :- Arc(x, _).\nTc(y, MIN(z)) :- Tc(x, z), Arc(x, y)."])
def test_replaced_files_go_and_the_dynamic_difference_is_taken(spark, monkeypatch, rules):
    import os

    from stratavane.plans import fixpoint
    from stratavane.plans.analysis import stratify
    from stratavane.plans.parser import parse

    program = parse(f"EDB_DECL:\nArc(x int, y int)\nIDB_DECL:\nTc(x int, y int)\nRULE_DECL:\n{rules}")
    taken, plain = [], fixpoint.Evaluator._two_phase

    def two_phase(self, state):
        taken.append((state.count / max(state.new, 1), state.overlap, plain(self, state)))
        return taken[-1][-1]

    monkeypatch.setattr(fixpoint.Evaluator, "_two_phase", two_phase)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    counts = []
    for options in (fixpoint.Options(compact_every=3, two_phase_rows=0), fixpoint.Options(set_difference="one_phase")):
        run = fixpoint.Evaluator(spark, program, _cycle(spark), options)
        for stratum in stratify(program):
            run.evaluate(stratum, False)
        counts.append(sorted(map(tuple, run.tables["Tc"].collect())))
        if len(counts) == 1:
            assert len(set(os.listdir(shared)) - before) <= 8
    assert counts[0] == counts[1]
    if "MIN" not in rules:
        assert any(two for *_, two in taken) and any(not two for *_, two in taken)
        assert all(0 <= overlap <= 1 for _, overlap, _ in taken if overlap is not None)
