"""Queries over the driver's tables, one for each operator of the language, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .engine import Engine

# Input relations, as DataFrames for the engine and as SQL for comparison.

DECLARED = {
    "Ord": "Ord(o int, c int)",
    "Line": "Line(o int, p int, s int, n int)",
    "Cust": "Cust(c int, n int, g varchar)",
    "Supp": "Supp(s int, n int)",
    "Part": "Part(p int, z int)",
    "Nation": "Nation(n int, name varchar, r int)",
    "Region": "Region(r int, name varchar)",
    "Arc": "Arc(x int, y int)",
    "ArcW": "ArcW(x int, y int, w int)",
    "Assign": "Assign(x int, y int)",
    "Deref": "Deref(x int, y int)",
    "Load": "Load(x int, y int)",
    "Store": "Store(x int, y int)",
    "AddressOf": "AddressOf(x int, y int)",
    "LineS": "LineS([o] int, s int)",
    "SuppK": "SuppK([s] int, t int)",
    "LineP": "LineP([o] int, p int)",
    "PartK": "PartK([p] int, z int)",
}

# Graphs over all rows of ``lineitem``: an order's lines lead to it from earlier orders of its batch of 32
# orders (of 8 for the pointer relations), so closures are linear in the input and components are bounded.
_FROM = "l_orderkey - l_orderkey % 32 + floor((l_orderkey % 32) * (l_partkey % 32) / 32)"
_POINTER = "SELECT DISTINCT CAST(l_orderkey AS INT) AS x, CAST(l_orderkey - l_orderkey % 8 + l_partkey % 8 AS INT) AS y FROM lineitem WHERE (l_linenumber + 4) % 5 + 1 = {}"
#: The same text is right in Spark SQL and DuckDB.
TABLES = {
    "Ord": "SELECT CAST(o_orderkey AS INT) AS o, CAST(o_custkey AS INT) AS c FROM orders",
    "Line": "SELECT CAST(l_orderkey AS INT) AS o, CAST(l_partkey AS INT) AS p, CAST(l_suppkey AS INT) AS s, l_linenumber AS n FROM lineitem",
    "Cust": "SELECT CAST(c_custkey AS INT) AS c, c_nationkey AS n, c_mktsegment AS g FROM customer",
    "Supp": "SELECT CAST(s_suppkey AS INT) AS s, s_nationkey AS n FROM supplier",
    "Part": "SELECT CAST(p_partkey AS INT) AS p, p_size AS z FROM part",
    "Nation": "SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation",
    "Region": "SELECT r_regionkey AS r, r_name AS name FROM region",
    "Arc": f"SELECT DISTINCT CAST({_FROM} AS INT) AS x, CAST(l_orderkey AS INT) AS y FROM lineitem",
    "ArcW": f"SELECT CAST({_FROM} AS INT) AS x, CAST(l_orderkey AS INT) AS y, min(CAST((l_orderkey + l_partkey) % 17 + 1 AS INT)) AS w FROM lineitem GROUP BY 1, 2",
    "Assign": _POINTER.format(1),
    "Deref": _POINTER.format(2),
    "Load": _POINTER.format(3),
    "Store": _POINTER.format(4),
    "AddressOf": _POINTER.format(5),
    "LineS": "SELECT DISTINCT CAST(l_orderkey AS INT) AS o, CAST(l_suppkey AS INT) AS s FROM lineitem",
    "SuppK": "SELECT CAST(s_suppkey AS INT) AS s, s_nationkey AS t FROM supplier WHERE s_nationkey < 12",
    "LineP": "SELECT DISTINCT CAST(l_orderkey AS INT) AS o, CAST(l_partkey AS INT) AS p FROM lineitem",
    "PartK": "SELECT CAST(p_partkey AS INT) AS p, p_size AS z FROM part WHERE p_size > 15",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def inputs(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The relations, read from Parquet with the columns they need."""
    texts = {n: TABLES[n] for n in names}
    used = [t for t in _BASE if any(t in text for text in texts.values())]
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    out = {}
    for name, text in texts.items():
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        out[name] = spark.sql(text, **{t: df for t, df in given.items() if f"{{{t}}}" in text})
    return out


def program(reads: list[str], derived: str, rules: str) -> str:
    lines = ["EDB_DECL:", *[DECLARED[n] for n in reads], "", "IDB_DECL:", *[x.strip() for x in derived.split(";")], "", "RULE_DECL:", rules.strip()]
    return "\n".join(lines) + "\n"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PROGRAMS: dict[str, str] = {}


def _with(reads: list[str], sql: str) -> str:
    parts = ", ".join(f"{n.lower()}{'_' * (n.lower() in _BASE)} AS ({TABLES[n]})" for n in reads)
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{parts}{', ' if sql.lstrip().startswith('RECURSIVE') else ' '}{sql.lstrip().removeprefix('RECURSIVE')}"


def _add(name: str, reads: list[str], derived: str, rules: str, result: str, sql: str | None, config: dict | None = None, certain: str | None = None) -> None:
    text = PROGRAMS[name] = program(reads, derived, rules)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, EngineConfig(**(config or {})))
        edb = inputs(spark, sf_dir, reads)
        return engine.certain(text, edb, certain) if certain else engine.run(text, edb)[result]

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = _with(reads, sql)


# Projection and filters

_add("p1_project", ["Line"], "P(o int, p int)", "P(o, p) :- Line(o, p, s, n).", "P", "SELECT DISTINCT o, p FROM line")
_add("p2_const_head", ["Ord"], "P(c int, k int, t varchar)", "P(c, 7, 'seen') :- Ord(_, c).", "P", "SELECT DISTINCT c, 7 AS k, 'seen' AS t FROM ord")
_add("p3_math_head", ["Line"], "P(o int, a int, b int, d int, e int)", "P(o, p + s, p - s, p * 2, p / 3) :- Line(o, p, s, _).", "P", "SELECT DISTINCT o, CAST(p + s AS INT) AS a, CAST(p - s AS INT) AS b, CAST(p * 2 AS INT) AS d, CAST(p // 3 AS INT) AS e FROM line")
_add("p4_dup_head", ["Ord"], "P(a int, b int)", "P(c, c) :- Ord(_, c).", "P", "SELECT DISTINCT c AS a, c AS b FROM ord")
_add("p5_wildcard", ["Line"], "P(p int)", "P(p) :- Line(_, p, _, _).", "P", "SELECT DISTINCT p FROM line")
_add("f1_const_filter", ["Line"], "P(o int, p int)", "P(o, p) :- Line(o, p, _, 1).", "P", "SELECT DISTINCT o, p FROM line WHERE n = 1")
_add("f2_string_filter", ["Cust"], "P(c int)", "P(c) :- Cust(c, _, 'BUILDING').", "P", "SELECT DISTINCT c FROM cust WHERE g = 'BUILDING'")
_add("f3_cmp_num", ["Line"], "P(o int, n int)", "P(o, n) :- Line(o, _, s, n), n >= 2, 5 > n, s != 3.", "P", "SELECT DISTINCT o, n FROM line WHERE n >= 2 AND n < 5 AND s <> 3")
_add("f4_cmp_var", ["Line", "Supp"], "P(o int, p int, s int)", "P(o, p, s) :- Line(o, p, s, n), Supp(s, m), n < m, p > s.", "P", "SELECT DISTINCT o, p, l.s FROM line l JOIN supp u ON l.s = u.s WHERE l.n < u.n AND p > l.s")
_add("f5_intra_eq", ["Line"], "P(o int, p int)", "P(o, p) :- Line(o, p, p, _).", "P", "SELECT DISTINCT o, p FROM line WHERE p = s")
_add("f7_assign", ["Line"], "P(o int, t int, u int)", "P(o, t, u) :- Line(o, p, s, _), t = p + s, u = t * 2, t > 10.", "P", "SELECT DISTINCT o, CAST(p + s AS INT) AS t, CAST((p + s) * 2 AS INT) AS u FROM line WHERE p + s > 10")
_add("f8_expr_join", ["Ord"], "P(a int, b int, d int)", "P(o, c, d) :- Ord(o, c), Ord(o - 1, d).", "P", "SELECT DISTINCT x.o AS a, x.c AS b, y.c AS d FROM ord x JOIN ord y ON y.o = x.o - 1")

# Aggregation and sets

_add("a1_min", ["Line"], "P(p int, v int)", "P(p, MIN(o)) :- Line(o, p, _, _).", "P", "SELECT p, min(o) AS v FROM line GROUP BY p")
_add("a2_max", ["Line"], "P(p int, v int)", "P(p, MAX(o)) :- Line(o, p, _, _).", "P", "SELECT p, max(o) AS v FROM line GROUP BY p")
_add("a3_sum", ["Line", "Part"], "P(s int, v long)", "P(s, SUM(z)) :- Line(_, p, s, _), Part(p, z).", "P", "SELECT s, CAST(sum(z) AS BIGINT) AS v FROM line JOIN part_ ON line.p = part_.p GROUP BY s")
_add("a4_count", ["Line"], "P(s int, v long)", "P(s, COUNT(o)) :- Line(o, _, s, _).", "P", "SELECT s, CAST(count(o) AS BIGINT) AS v FROM line GROUP BY s")
_add("a5_count_distinct", ["Line"], "P(s int, v long, w long)", "P(s, COUNT_DISTINCT(p), COUNT_DISTINCT(n)) :- Line(_, p, s, n).", "P", "SELECT s, CAST(count(DISTINCT p) AS BIGINT) AS v, CAST(count(DISTINCT n) AS BIGINT) AS w FROM line GROUP BY s")
_add("a6_agg_expr", ["Line"], "P(s int, v int, w long)", "P(s, MIN(o + p), SUM(n * 2)) :- Line(o, p, s, n).", "P", "SELECT s, CAST(min(o + p) AS INT) AS v, CAST(sum(n * 2) AS BIGINT) AS w FROM line GROUP BY s")
_add("a8_global_agg", ["Line"], "P(a int, b int, d long)", "P(MIN(o), MAX(p), COUNT(s)) :- Line(o, p, s, _).", "P", "SELECT min(o) AS a, max(p) AS b, CAST(count(s) AS BIGINT) AS d FROM line HAVING count(*) > 0")
_add("a9_dedup", ["Line"], "P(p int, s int)", "P(p, s) :- Line(_, p, s, _).", "P", "SELECT DISTINCT p, s FROM line")
_add("a10_bag", ["Line"], "P(p int, s int)", "P(p, s) :- Line(_, p, s, _).", "P", "SELECT p, s FROM line", {"selective_dedup": True})
_add("a13_two_aggregate_rules", ["Ord", "Line"], "P(k int, v int)", "P(c, MIN(o)) :- Ord(o, c).\nP(s, MIN(o)) :- Line(o, _, s, _).", "P", "SELECT c AS k, min(o) AS v FROM ord GROUP BY c UNION SELECT s, min(o) FROM line GROUP BY s")
_add("count_aggregation", ["Line"], "P(s int, y long, z long)", "P(s, COUNT_DISTINCT(o), COUNT_DISTINCT(p)) :- Line(o, p, s, _).", "P", "SELECT s, CAST(count(DISTINCT o) AS BIGINT) AS y, CAST(count(DISTINCT p) AS BIGINT) AS z FROM line GROUP BY s")
_add("u1_multi_rule", ["Ord", "Line"], "P(a int, b int)", "P(o, c) :- Ord(o, c).\nP(o, s) :- Line(o, _, s, _).", "P", "SELECT o AS a, c AS b FROM ord UNION SELECT o, s FROM line")
_add("u4_intersect", ["Ord", "Line"], "A(a int, b int); B(a int, b int); P(a int, b int)", "A(o, c) :- Ord(o, c).\nB(o, s) :- Line(o, _, s, _).\nP(x, y) :- A(x, y), B(x, y).", "P", "SELECT o AS a, c AS b FROM ord INTERSECT SELECT o, s FROM line")
_add("u5_difference", ["Ord", "Line"], "B(a int, b int); P(a int, b int)", "B(o, s) :- Line(o, _, s, _).\nP(x, y) :- Ord(x, y), !B(x, y).", "P", "SELECT o AS a, c AS b FROM ord EXCEPT SELECT o, s FROM line")

# Joins

_add("j1_join3", ["Cust", "Nation", "Region"], "P(c int, name varchar, region varchar)", "P(c, m, q) :- Cust(c, n, _), Nation(n, m, r), Region(r, q).", "P", "SELECT DISTINCT c, nation_.name AS name, region_.name AS region FROM cust JOIN nation_ ON cust.n = nation_.n JOIN region_ ON nation_.r = region_.r")
_add("j2_self_join", ["Arc"], "P(x int, z int)", "P(x, z) :- Arc(x, y), Arc(y, z).", "P", "SELECT DISTINCT a.x, b.y AS z FROM arc a JOIN arc b ON a.y = b.x")
_add("j3_theta", ["Supp"], "P(a int, b int)", "P(x, y) :- Supp(x, n), Supp(y, n), x < y.", "P", "SELECT DISTINCT a.s AS a, b.s AS b FROM supp a JOIN supp b ON a.n = b.n WHERE a.s < b.s")
_add("j4_cross", ["Nation", "Region"], "P(n int, r int)", "P(n, r) :- Nation(n, _, _), Region(r, _).", "P", "SELECT DISTINCT nation_.n, region_.r FROM nation_, region_")
_add("j5_negation", ["Cust", "Ord"], "P(c int)", "P(c) :- Cust(c, _, _), !Ord(_, c).", "P", "SELECT DISTINCT c FROM cust WHERE NOT EXISTS (SELECT * FROM ord WHERE ord.c = cust.c)")
_add("j5_negation_const", ["Ord", "Line"], "P(o int)", "P(o) :- Ord(o, _), !Line(o, _, _, 4).", "P", "SELECT DISTINCT o FROM ord WHERE NOT EXISTS (SELECT * FROM line WHERE line.o = ord.o AND n = 4)")
_add("j6_empty_negation", ["Cust", "Nation"], "E(n int); P(c int); Q(c int)", "E(n) :- Nation(n, _, _), n < 0.\nP(c) :- Cust(c, _, _), !E(_).\nQ(c) :- P(c), !Nation(_, _, 99).", "Q", "SELECT DISTINCT c FROM cust WHERE NOT EXISTS (SELECT * FROM nation_ WHERE n < 0) AND NOT EXISTS (SELECT * FROM nation_ WHERE r = 99)")
_add("stratified_negation", ["Arc"], "Tc(x int, y int); P(x int, y int)", "Tc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, z), Arc(z, y).\nP(x, y) :- Arc(x, z), Arc(y, z), !Tc(x, y).", "P",
     "RECURSIVE tc(x, y) AS (SELECT x, y FROM arc UNION SELECT tc.x, arc.y FROM tc JOIN arc ON tc.y = arc.x) SELECT DISTINCT a.x, b.x AS y FROM arc a JOIN arc b ON a.y = b.y WHERE NOT EXISTS (SELECT * FROM tc WHERE tc.x = a.x AND tc.y = b.x)")

# Recursion

_TC = "RECURSIVE tc(x, y) AS (SELECT x, y FROM arc UNION SELECT tc.x, arc.y FROM tc JOIN arc ON tc.y = arc.x) SELECT x, y FROM tc"
_add("r1_tc", ["Arc"], "Tc(x int, y int)", "Tc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, w), Arc(w, y).", "Tc", _TC)
_add("r10_tc_two_phase", ["Arc"], "Tc(x int, y int)", "Tc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, w), Arc(w, y).", "Tc", _TC, {"set_difference": "two_phase"})
_add("r4_tc_nonlinear", ["Arc"], "Tc(x int, y int)", "Tc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, w), Tc(w, y).", "Tc", _TC)
_add("r1_sg", ["Arc"], "Sg(x int, y int)", "Sg(x, y) :- Arc(p, x), Arc(p, y), x != y.\nSg(x, y) :- Arc(a, x), Sg(a, b), Arc(b, y).", "Sg",
     "RECURSIVE sg(x, y) AS (SELECT a.y, b.y FROM arc a JOIN arc b ON a.x = b.x WHERE a.y <> b.y UNION SELECT a.y, b.y FROM sg JOIN arc a ON a.x = sg.x JOIN arc b ON b.x = sg.y) SELECT x, y FROM sg")
_add("r3_reach", ["Arc"], "Reach(x int)", "Reach(448) :-.\nReach(y) :- Reach(x), Arc(x, y).", "Reach", "RECURSIVE reach(x) AS (SELECT CAST(448 AS INT) UNION SELECT arc.y FROM reach JOIN arc ON reach.x = arc.x) SELECT x FROM reach")
_add("r1_csda", ["Supp", "Arc"], "Null(x int, y int)", "Null(x, y) :- Supp(x, y).\nNull(x, y) :- Null(x, w), Arc(w, y).", "Null", "RECURSIVE nul(x, y) AS (SELECT s, n FROM supp UNION SELECT nul.x, arc.y FROM nul JOIN arc ON nul.y = arc.x) SELECT x, y FROM nul")
_add("r6_mutual", ["Arc"], "Odd(x int, y int); Even(x int, y int)", "Odd(x, y) :- Arc(x, y).\nOdd(x, y) :- Even(x, z), Arc(z, y).\nEven(x, y) :- Odd(x, z), Arc(z, y).", "Even",
     "RECURSIVE t(r, x, y) AS (SELECT 1, x, y FROM arc UNION SELECT 1 - t.r, t.x, arc.y FROM t JOIN arc ON t.y = arc.x) SELECT x, y FROM t WHERE r = 0")
_add("r6_cspa", ["Assign", "Deref"], "ValueFlow(x int, y int); ValueAlias(x int, y int); MemoryAlias(x int, y int); P(r int, x int, y int)",
     """ValueFlow(y, x) :- Assign(y, x).
ValueFlow(x, y) :- Assign(x, z), MemoryAlias(z, y).
ValueFlow(x, y) :- ValueFlow(x, z), ValueFlow(z, y).
MemoryAlias(x, w) :- Deref(y, x), ValueAlias(y, z), Deref(z, w).
ValueAlias(x, y) :- ValueFlow(z, x), ValueFlow(z, y).
ValueAlias(x, y) :- ValueFlow(z, x), MemoryAlias(z, w), ValueFlow(w, y).
ValueFlow(x, x) :- Assign(x, y).
ValueFlow(x, x) :- Assign(y, x).
MemoryAlias(x, x) :- Assign(y, x).
MemoryAlias(x, x) :- Assign(x, y).
P(1, x, y) :- ValueFlow(x, y).
P(2, x, y) :- ValueAlias(x, y).
P(3, x, y) :- MemoryAlias(x, y).""", "P",
     """RECURSIVE t(r, x, y, k) USING KEY (r, x, y) AS (
  (SELECT 1 AS r, x, y, 1 AS k FROM assign UNION SELECT 1, x, x, 1 FROM assign UNION SELECT 1, y, y, 1 FROM assign UNION SELECT 3, x, x, 1 FROM assign UNION SELECT 3, y, y, 1 FROM assign)
  UNION (
   SELECT 1, a.x, m.y, 1 FROM assign a JOIN recurring.t m ON m.r = 3 AND m.x = a.y
   UNION SELECT 1, a.x, b.y, 1 FROM recurring.t a JOIN recurring.t b ON a.r = 1 AND b.r = 1 AND a.y = b.x
   UNION SELECT 3, d.y, e.y, 1 FROM deref d JOIN recurring.t v ON v.r = 2 AND v.x = d.x JOIN deref e ON e.x = v.y
   UNION SELECT 2, a.y, b.y, 1 FROM recurring.t a JOIN recurring.t b ON a.r = 1 AND b.r = 1 AND a.x = b.x
   UNION SELECT 2, a.y, b.y, 1 FROM recurring.t a JOIN recurring.t m ON a.r = 1 AND m.r = 3 AND m.x = a.x JOIN recurring.t b ON b.r = 1 AND b.x = m.y))
SELECT r, x, y FROM t""")  # fmt: skip
_add("r4_andersen", ["AddressOf", "Assign", "Load", "Store"], "PointsTo(x int, y int)",
     "PointsTo(y, x) :- AddressOf(y, x).\nPointsTo(y, x) :- Assign(y, z), PointsTo(z, x).\nPointsTo(y, w) :- Load(y, x), PointsTo(x, z), PointsTo(z, w).\nPointsTo(z, w) :- Store(y, x), PointsTo(y, z), PointsTo(x, w).", "PointsTo",
     """RECURSIVE t(x, y, k) USING KEY (x, y) AS (
  SELECT x, y, 1 AS k FROM addressof
  UNION (SELECT a.x, p.y, 1 FROM assign a JOIN recurring.t p ON p.x = a.y
   UNION SELECT l.x, q.y, 1 FROM load l JOIN recurring.t p ON p.x = l.y JOIN recurring.t q ON q.x = p.y
   UNION SELECT p.y, q.y, 1 FROM store s JOIN recurring.t p ON p.x = s.x JOIN recurring.t q ON q.x = s.y))
SELECT x, y FROM t""")  # fmt: skip
_add("r7_cc", ["Arc"], "Cc3(x int, y int); Cc2(x int, y int)", "Cc3(x, MIN(x)) :- Arc(x, _).\nCc3(y, MIN(z)) :- Cc3(x, z), Arc(x, y).\nCc2(x, MIN(y)) :- Cc3(x, y).", "Cc2",
     "RECURSIVE tc(x, y) AS (SELECT x, y FROM arc UNION SELECT tc.x, arc.y FROM tc JOIN arc ON tc.y = arc.x) SELECT x, CAST(min(y) AS INT) AS y FROM (SELECT x, x AS y FROM arc UNION SELECT y, x FROM tc) GROUP BY x")
_add("r7_sssp", ["ArcW"], "Sssp2(x int, y int); Sssp(x int, y int)", "Sssp2(448, 0) :-.\nSssp2(y, MIN(d1 + d2)) :- Sssp2(x, d1), ArcW(x, y, d2).\nSssp(x, MIN(d)) :- Sssp2(x, d).", "Sssp",
     """RECURSIVE d(x, y) USING KEY (x) AS (
  SELECT CAST(448 AS INT) AS x, CAST(0 AS INT) AS y
  UNION (SELECT a.y, CAST(min(d.y + a.w) AS INT) FROM d JOIN arcw a ON d.x = a.x LEFT JOIN recurring.d o ON o.x = a.y
         GROUP BY a.y, o.y HAVING o.y IS NULL OR min(d.y + a.w) < o.y))
SELECT x, y FROM d""")  # fmt: skip
_add("r16_bounded_path", ["ArcW"], "Path(x int, y int, w int)", "Path(x, y, w) :- ArcW(x, y, w).\nPath(x, y, d1 + d2) :- Path(x, z, d1), ArcW(z, y, d2).", "Path",
     "RECURSIVE p(x, y, w, k) AS (SELECT x, y, w, 1 FROM arcw UNION SELECT p.x, a.y, CAST(p.w + a.w AS INT), k + 1 FROM p JOIN arcw a ON p.y = a.x WHERE k < 4) SELECT DISTINCT x, y, w FROM p", {"stop_after": 3})
_add("r17_facts", ["Region"], "P(r int, name varchar)", "P(100, 'NOWHERE') :-.\nP(101, 'ELSEWHERE') :-.\nP(r, m) :- Region(r, m).", "P", "SELECT r, name FROM region_ UNION SELECT 100, 'NOWHERE' UNION SELECT 101, 'ELSEWHERE'")
_add("stratified_prefix_max", ["Nation"], "arc(t int, w int); elems(t int, j int, w int); presum(x int, y int)",
     "arc(n, MAX(r)) :- Nation(n, _, r).\nelems(t, t, w) :- arc(t, w).\nelems(t, j, w) :- arc(t, _), arc(t - 1, _), elems(t - 1, j, w), 0 <= j, j < t.\npresum(x, MAX(y)) :- elems(x, _, y).", "presum",
     "SELECT a.n AS x, CAST(max(b.r) AS INT) AS y FROM nation_ a JOIN nation_ b ON b.n <= a.n GROUP BY a.n")

# Consistent answers

_LINES = "SELECT l.o FROM lines l LEFT JOIN suppk u ON l.s = u.s GROUP BY l.o HAVING count(*) = count(u.t)"
_add("c9_certain_join", ["LineS", "SuppK"], "Q(o int)", "Q(o) :- LineS(o, s), SuppK(s, t).", "Q", _LINES, certain="attack_graph")
_add("c9_certain_const", ["LineS", "SuppK"], "Q(o int)", "Q(o) :- LineS(o, s), SuppK(s, 3).", "Q", "SELECT l.o FROM lines l LEFT JOIN suppk u ON l.s = u.s AND u.t = 3 GROUP BY l.o HAVING count(*) = count(u.t)", certain="attack_graph")
_add("c16_certain_join_tree", ["LineS", "SuppK"], "Q(o int)", "Q(o) :- LineS(o, s), SuppK(s, t).", "Q", _LINES, certain="join_graph")
_BOTH = f"{_LINES} INTERSECT SELECT l.o FROM linep l LEFT JOIN partk u ON l.p = u.p GROUP BY l.o HAVING count(*) = count(u.z)"
_add("c14_certain_key_join", ["LineS", "SuppK", "LineP", "PartK"], "Q(o int)", "Q(o) :- LineS(o, s), SuppK(s, t), LineP(o, p), PartK(p, z).", "Q", _BOTH, certain="join_graph")
_add("c19_certain_forest", ["SuppK", "LineP", "PartK"], "Q(o int, s int)", "Q(o, s) :- LineP(o, p), PartK(p, z), SuppK(s, 3).", "Q",
     "SELECT o, s FROM (SELECT l.o FROM linep l LEFT JOIN partk u ON l.p = u.p GROUP BY l.o HAVING count(*) = count(u.z)), (SELECT s FROM suppk GROUP BY s HAVING min(t) = 3 AND max(t) = 3)", certain="join_graph")
_add("c20_certain_union", ["LineS", "SuppK"], "Q(o int)", "Q(o) :- LineS(o, s), SuppK(s, 3).\nQ(o) :- LineS(o, s), SuppK(s, 4).", "Q",
     "SELECT l.o FROM lines l LEFT JOIN suppk u ON l.s = u.s AND u.t = 3 GROUP BY l.o HAVING count(*) = count(u.t) UNION SELECT l.o FROM lines l LEFT JOIN suppk u ON l.s = u.s AND u.t = 4 GROUP BY l.o HAVING count(*) = count(u.t)", certain="pair_pruning")


def s1_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input relations from CSV: the table is written by the CSV sink and read by the CSV source."""
    from .sources import fresh_path, write_csv

    folder = fresh_path(spark, "csv")
    write_csv(inputs(spark, sf_dir, ["Ord"])["Ord"], folder, "Ord", "|")
    text = program(["Ord"], "P(c int, o int)", "P(c, o) :- Ord(o, c).")
    return Engine(spark, EngineConfig(input_dir=folder, csv_delimiter="|")).run(text)["P"]


def s10_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table appended to another, without and with removal of those already there."""
    from .sources import append

    t = inputs(spark, sf_dir, ["Ord", "Line"])
    first = append(t["Line"].select("o", F.col("s").alias("c")), t["Ord"])
    return append(t["Line"].select("o", F.col("p").alias("c")), first, dedup=True)


def s12_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over a derived relation."""
    engine = Engine(spark)
    engine.run(program(["Ord"], "Pairs(o int, c int)", "Pairs(o, c) :- Ord(o, c)."), inputs(spark, sf_dir, ["Ord"]))
    return engine.sql("SELECT c, count(*) AS n FROM Pairs GROUP BY c")


def r14_single_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program without recursion as one lazy plan."""
    text = program(["Cust", "Ord"], "A(c int, o int); P(n int, v long)", "A(c, o) :- Ord(o, c).\nP(n, COUNT(o)) :- Cust(c, n, _), A(c, o).")
    return Engine(spark).to_dataframe(text, "P", inputs(spark, sf_dir, ["Cust", "Ord"]))


QUERIES |= {f.__name__: f for f in (s1_csv_round_trip, s10_append, s12_sql, r14_single_plan)}
ORACLES |= {
    "s1_csv_round_trip": _with(["Ord"], "SELECT DISTINCT c, o FROM ord"),
    "s10_append": _with(["Ord", "Line"], "SELECT o, c FROM ord UNION ALL SELECT o, s FROM line UNION ALL (SELECT o, p FROM line EXCEPT (SELECT o, c FROM ord UNION SELECT o, s FROM line))"),
    "s12_sql": _with(["Ord"], "SELECT c, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT o, c FROM ord) GROUP BY c"),
    "r14_single_plan": _with(["Cust", "Ord"], "SELECT n, CAST(count(o) AS BIGINT) AS v FROM cust JOIN (SELECT DISTINCT o, c FROM ord) USING (c) GROUP BY n"),
}
