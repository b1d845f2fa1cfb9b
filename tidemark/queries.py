"""The engine's own queries, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import gadgets
from tidemark.functions.terms import Atom, Body, Rule, Search, Var, rule, search, variables
from tidemark.operators.candidates import candidates
from tidemark.operators.coverage import Coverage, Reduction, gaps, overlaps
from tidemark.operators.lower import instantiate_head, lower
from tidemark.operators.relation import MARK, Relation, spread
from tidemark.operators.saturate import saturate
from tidemark.operators.sinks import Sink, sink_all
from tidemark.operators.skolem import skolemize
from tidemark.plans.ir import antijoin, natural_join, project, scan
from tidemark.plans.planner import plan_body
from tidemark.sources.tables import Tables
from tidemark.streaming.session import Deduction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_HOP = """hop AS (SELECT DISTINCT CAST(x.l_suppkey AS BIGINT) AS a, CAST(y.l_suppkey AS BIGINT) AS b FROM lineitem x JOIN lineitem y
  ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1)"""
_CLOSURE = f"WITH RECURSIVE {_HOP}, r(a, b) AS (SELECT a, b FROM hop UNION SELECT r.a, hop.b FROM r JOIN hop ON r.b = hop.a)"


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _holds(relation: Relation) -> DataFrame:
    return relation.df.select(F.col(MARK).alias("holds"))


def _body(*atoms: Atom) -> Body:
    return Body([t for a in atoms for t in a.vars], atoms)


@_query("SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_partkey AS BIGINT) AS p FROM lineitem WHERE l_suppkey = 7")
def filter_const(spark, sf):
    o, p = variables("o p")
    return lower(scan(Atom("item", o, p, 7)), Tables(spark, sf).all("item"), spark).named()


@_query(f"WITH {_HOP} SELECT a AS x FROM hop WHERE a = b")
def filter_repeat(spark, sf):
    (x,) = variables("x")
    return lower(scan(Atom("hop", x, x)), {"hop": Tables(spark, sf).hop()}, spark).named()


@_query("SELECT CAST(l_suppkey AS BIGINT) AS s FROM lineitem")
def project_bag(spark, sf):
    o, p, s = variables("o p s")
    return lower(project(scan(Atom("item", o, p, s)), [s]), Tables(spark, sf).all("item"), spark).named()


@_query("SELECT CAST(l_suppkey AS BIGINT) AS s, count(*) AS multiplicity FROM lineitem GROUP BY ALL")
def sink_multiplicity(spark, sf):
    o, p, s = variables("o p s")
    found = lower(project(scan(Atom("item", o, p, s)), [s]), Tables(spark, sf).all("item"), spark)
    return Sink(found.shape).attach(found).snapshot().toDF("s", "multiplicity")


@_query("SELECT CAST(c_custkey AS BIGINT) AS c, CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def natural_join_query(spark, sf):
    c, n, r = variables("c n r")
    plan = natural_join((scan(Atom("cust_nation", c, n)), scan(Atom("in_region", n, r))))
    return lower(plan, Tables(spark, sf).all("cust_nation", "in_region"), spark).named()


@_query("SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region, nation")
def cross_product(spark, sf):
    r, n = variables("r n")
    return lower(natural_join((scan(Atom("region", r)), scan(Atom("nation", n)))), Tables(spark, sf).all("region", "nation"), spark).named()


@_query("""SELECT DISTINCT CAST(o_custkey AS BIGINT) AS c, CAST(l_suppkey AS BIGINT) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey""")
def local_supplier(spark, sf):
    c, s, n, o, p = variables("c s n o p")
    body = Body([c, s], [Atom("placed", c, o), Atom("item", o, p, s), Atom("cust_nation", c, n), Atom("supp_nation", s, n)])
    facts = Tables(spark, sf).all("placed", "item", "cust_nation", "supp_nation")
    return lower(plan_body(body, {k: v.shape for k, v in facts.items()}, spread(facts)), facts, spark).distinct().named()


@_query("SELECT CAST(p_partkey AS BIGINT) AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 7)")
def antijoin_one(spark, sf):
    p, o = variables("p o")
    plan = antijoin(scan(Atom("part", p)), [p], [project(scan(Atom("item", o, p, 7)), [p])])
    return lower(plan, Tables(spark, sf).all("part", "item"), spark).named()


@_query("SELECT CAST(p_partkey AS BIGINT) AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey IN (7, 8))")
def antijoin_multi(spark, sf):
    p, o = variables("p o")
    plan = antijoin(scan(Atom("part", p)), [p], [project(scan(Atom("item", o, p, k)), [p]) for k in (7, 8)])
    return lower(plan, Tables(spark, sf).all("part", "item"), spark).named()


def _transitive(into: str = "hop", start: str = "hop") -> Rule:
    x, y, z = variables("x y z")
    return rule(Atom(into, x, z), Atom(start, x, y), Atom(start, y, z))


@_query(f"{_CLOSURE} SELECT a, b FROM r")
def hop_closure(spark, sf):
    return saturate(spark, [_transitive()], {"hop": Tables(spark, sf).hop_bag()})["hop"].named("a", "b")


@_query(f"""WITH RECURSIVE {_HOP}, both_ways AS (SELECT a, b FROM hop UNION SELECT b, a FROM hop),
  r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a) SELECT a, b FROM r""")
def hop_closure_sym(spark, sf):
    x, y = variables("x y")
    return saturate(spark, [_transitive(), rule(Atom("hop", y, x), Atom("hop", x, y))], {"hop": Tables(spark, sf).hop_bag()})["hop"].named("a", "b")


@_query(f"WITH {_HOP} SELECT DISTINCT x.a, y.b FROM hop x JOIN hop y ON x.b = y.a")
def hop_two(spark, sf):
    return saturate(spark, [_transitive("two")], {"hop": Tables(spark, sf).hop_bag()})["two"].named("a", "b")


@_query(f"""WITH RECURSIVE {_HOP}, odd(a, b, k) AS (SELECT a, b, 1 FROM hop UNION SELECT o.a, hop.b, 1 - o.k FROM odd o JOIN hop ON o.b = hop.a)
  SELECT DISTINCT a, b, CAST(k AS BIGINT) AS k FROM odd""")
def mutual_recursion(spark, sf):
    """Pairs joined by an odd walk (k = 1) and by an even one (k = 0): two predicates that need each other."""
    x, y, z = variables("x y z")
    rules = [rule(Atom("odd", x, y), Atom("hop", x, y)), rule(Atom("even", x, z), Atom("odd", x, y), Atom("hop", y, z)), rule(Atom("odd", x, z), Atom("even", x, y), Atom("hop", y, z))]
    found = saturate(spark, rules, {"hop": Tables(spark, sf).hop_bag()})
    return found["odd"].named("a", "b").withColumn("k", F.lit(1).cast("long")).unionByName(found["even"].named("a", "b").withColumn("k", F.lit(0).cast("long")))


@_query(f"WITH {_HOP} SELECT DISTINCT a AS node FROM (SELECT a FROM hop UNION ALL SELECT b FROM hop)")
def several_heads(spark, sf):
    x, y = variables("x y")
    return saturate(spark, [rule([Atom("node", x), Atom("node", y), Atom("back", y, x)], Atom("hop", x, y))], {"hop": Tables(spark, sf).hop()})["node"].named("node")


@_query(f"WITH {_HOP} SELECT a AS x, b AS z FROM hop h WHERE NOT EXISTS (SELECT 1 FROM hop p JOIN hop q ON p.b = q.a WHERE p.a = h.a AND q.b = h.b)")
def search_exists(spark, sf):
    x, z, y = variables("x z y")
    s = search(_body(Atom("hop", x, z)), [Atom("hop", x, y), Atom("hop", y, z)])
    return candidates(spark, [s], {"hop": Tables(spark, sf).hop_bag().packed()})[s].named()


@_query("""SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_partkey AS BIGINT) AS p FROM lineitem WHERE NOT EXISTS
  (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = l_orderkey AND c_nationkey = 3)""")
def search_two_atoms(spark, sf):
    """Lines for which no customer of nation 3 placed the order; the customer is existential and joins two atoms."""
    o, p, s, c = variables("o p s c")
    wanted = search(Body([o, p], [Atom("item", o, p, s)]), [Atom("placed", c, o), Atom("cust_nation", c, 3)])
    facts = Tables(spark, sf).all("item", "placed", "cust_nation")
    return candidates(spark, [wanted], facts)[wanted].named()


@_query(f"WITH {_HOP} SELECT CAST(s_suppkey AS BIGINT) AS x FROM supplier WHERE s_suppkey NOT IN (SELECT a FROM hop)")
def search_exists_unary(spark, sf):
    x, y = variables("x y")
    s = search(_body(Atom("supplier", x)), [Atom("hop", x, y)])
    t = Tables(spark, sf)
    return candidates(spark, [s], {"supplier": t["supplier"], "hop": t.hop()})[s].named()


@_query("""SELECT CAST(c_custkey AS BIGINT) AS c FROM customer WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def search_disjunction(spark, sf):
    c, o = variables("c o")
    t = Tables(spark, sf)
    s = search(_body(Atom("customer", c)), [Atom("placed", c, o), Atom("urgent", o)], [Atom("placed", c, o), Atom("high", o)])
    facts = t.all("customer", "placed") | {"urgent": t.with_priority("1-URGENT"), "high": t.with_priority("2-HIGH")}
    return candidates(spark, [s], facts)[s].named()


@_query("""SELECT CAST(c_custkey AS BIGINT) AS c FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE c_acctbal < 0 AND o_orderpriority = '1-URGENT'""")
def search_falsum(spark, sf):
    c, o = variables("c o")
    t = Tables(spark, sf)
    s = Search(Body([c], [Atom("in_debt", c), Atom("placed", c, o), Atom("urgent", o)]))
    facts = t.all("placed") | {"in_debt": Relation.facts(t.raw("customer").where("c_acctbal < 0").select("c_custkey")), "urgent": t.with_priority("1-URGENT")}
    return candidates(spark, [s], facts)[s].named()


@_query(f"{_CLOSURE} SELECT a, b FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.a = r.b AND q.b = r.a)")
def saturate_then_search(spark, sf):
    a, b = variables("a b")
    s = search(_body(Atom("hop", a, b)), [Atom("hop", b, a)])
    session = Deduction(spark, [_transitive()], [s])
    session.insert("hop", Tables(spark, sf).hop().named("a", "b"))
    session.advance(1)
    return session.candidates()[s].named()


@_query("""SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) AS BIGINT) AS multiplicity FROM events
  WHERE event_type IN ('view', 'error') GROUP BY user_id HAVING sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) <> 0""")
def signed_sink(spark, sf):
    rows = Tables(spark, sf).raw("events").where("event_type IN ('view', 'error')").select("user_id", F.when(F.col("event_type") == "view", 1).otherwise(-1).alias("w"))
    user = Relation.facts(rows, signed=True)
    return Sink(1).attach(user).snapshot().toDF("user_id", "multiplicity")


@_query("SELECT CAST(multiplicity AS BIGINT) AS multiplicity, count(*) AS users FROM (SELECT count(*) * (SELECT count(*) FROM region) AS multiplicity FROM events WHERE event_type = 'view' GROUP BY user_id) GROUP BY ALL")
def weighted_join(spark, sf):
    """Multiplicities multiply in a join and add up when columns are dropped."""
    user, region = variables("user region")
    t = Tables(spark, sf)
    views = Relation.facts(t.raw("events").where("event_type = 'view'").select("user_id")).weighted()
    plan = project(natural_join((scan(Atom("view", user)), scan(Atom("region", region)))), [user])
    return lower(plan, {"view": views, "region": t["region"]}, spark).consolidated().df.groupBy(F.col("_w").alias("multiplicity")).agg(F.count(F.lit(1)).alias("users"))


_PAIRS = """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier)"""


def _supplier_space(spark, sf):
    t = Tables(spark, sf)
    nations = t.raw("nation").select(F.lit(0).cast("long").alias("choice_id"), F.concat(F.lit("nation "), F.col("n_nationkey")).alias("atom"))
    suppliers = t.raw("supplier").select(F.lit(1).cast("long").alias("choice_id"), F.concat(F.lit("supplier "), F.col("s_suppkey")).alias("atom"))
    pairs = t.raw("supplier").select(F.col("s_suppkey").alias("region_id"), F.explode(F.array(F.concat(F.lit("supplier "), F.col("s_suppkey")), F.concat(F.lit("nation "), F.col("s_nationkey")))).alias("atom"))
    return nations.unionByName(suppliers), pairs


def _pair(states: DataFrame) -> DataFrame:
    return states.select(F.element_at("state", 1).alias("nation"), F.element_at("state", 2).alias("supplier"))


@_query(f"{_PAIRS} SELECT 'nation ' || n_nationkey AS nation, 'supplier ' || k AS supplier FROM nation, s WHERE CAST(n_nationkey AS VARCHAR) <> s.n")
def coverage_gaps(spark, sf):
    return _pair(gaps(spark, *_supplier_space(spark, sf)))


@_query(f"{_PAIRS} SELECT 'nation ' || n AS nation, 'supplier ' || k AS supplier FROM s WHERE k = '3'")
def coverage_overlap(spark, sf):
    return _pair(overlaps(spark, *_supplier_space(spark, sf), ["supplier 3"]))


def _nations(spark, sf) -> list:
    """(nation, region, number of regions): declared constraints, 25 rows."""
    t = Tables(spark, sf)
    regions = t.raw("region").agg(F.count(F.lit(1)).alias("n"))
    return t.raw("nation").crossJoin(F.broadcast(regions)).select("n_nationkey", "n_regionkey", "n").orderBy("n_nationkey").collect()


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def coverage_witness(spark, sf):
    """For each nation the one region that is left when all others are fathomed."""
    found = []
    for nation, region, n in _nations(spark, sf):
        space = Coverage()
        space.declare_choice(range(n))
        for r in range(n):
            if r != region:
                space.add_nogood([r])
        found += [(nation, r) for r in space.gap_witness()]
    return spark.createDataFrame(found, "nation long, region long")


@_query("""SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST((n_regionkey + 1) % (SELECT count(*) FROM region) AS BIGINT) AS region, policy, 2 AS kept
  FROM nation, (VALUES ('ONE_SHOT'), ('IN_ORDER'), ('GREEDY')) p(policy)""")
def coverage_reduce(spark, sf):
    """A nation with a region that is not its own is clear of all pairs; a third choice plays no part and is dropped."""
    rows, space = _nations(spark, sf), Coverage()
    for choice in ([f"nation {r[0]}" for r in rows], [f"region {r}" for r in range(rows[0][2])], ["lit", "dark"]):
        space.declare_choice(choice)
    for nation, region, _ in rows:
        space.add_nogood([f"nation {nation}", f"region {region}"])
    found = []
    for nation, region, n in rows:
        for policy in (Reduction.ONE_SHOT, Reduction.IN_ORDER, Reduction.GREEDY):
            kept = space.disjoint_from_nogoods([f"nation {nation}", f"region {(region + 1) % n}", "lit"], policy)
            words = dict(a.split() for a in kept if " " in a)
            found.append((int(words["nation"]), int(words["region"]), policy.name, len(kept)))
    return spark.createDataFrame(found, "nation long, region long, policy string, kept int")


@_query("""SELECT CAST(s_suppkey AS BIGINT) AS s, NOT (a AND b AND c) AS not_all, a OR b OR c AS at_least_one, x <= 1 AS at_most_one, x = 1 AS exactly_one,
  c = (a AND b) AS stands_for_all, c = (a OR b) AS stands_for_either
  FROM (SELECT s_suppkey, a, b, c, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS x
        FROM (SELECT s_suppkey, s_acctbal < 5000 AS a, s_nationkey < 12 AS b, s_suppkey % 2 = 0 AS c FROM supplier))""")
def gadget_constraints(spark, sf):
    a, b, c = F.col("s_acctbal") < 5000, F.col("s_nationkey") < 12, F.col("s_suppkey") % 2 == 0
    found = {"not_all": gadgets.not_all([a, b, c]), "at_least_one": gadgets.at_least_one([a, b, c]), "at_most_one": gadgets.at_most_one([a, b, c]), "exactly_one": gadgets.exactly_one([a, b, c])}
    found |= {"stands_for_all": gadgets.stands_for_all(c, [a, b]), "stands_for_either": gadgets.stands_for_either(c, a, b)}
    return Tables(spark, sf).raw("supplier").select(F.col("s_suppkey").cast("long").alias("s"), *[v.alias(k) for k, v in found.items()])


@_query(f"WITH {_HOP} SELECT x.a, x.b FROM hop x JOIN hop y ON x.a = y.b AND x.b = y.a")
def intersect(spark, sf):
    """A natural join on all variables: edges that go both ways."""
    a, b = variables("a b")
    hop = Tables(spark, sf).hop().stored()
    return lower(natural_join((scan(Atom("hop", a, b)), scan(Atom("hop", b, a)))), {"hop": hop}, spark).named()


@_query("SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS s FROM lineitem")
def sink_values(spark, sf):
    o, p, s = variables("o p s")
    found = lower(project(scan(Atom("item", o, p, s)), [s]), Tables(spark, sf).all("item"), spark)
    return sink_all({"s": found})["s"].values().toDF("s")


@_query("""WITH i AS (SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT DISTINCT a.n AS a, b.n AS b FROM i a JOIN i b ON a.r = b.r WHERE a.r <> 'ASIA'""")
def text_keys(spark, sf):
    """Rules over names: new predicates, recursion, constants and a search, all on text."""
    a, b, c, r = variables("a b c r")
    names = Tables(spark, sf).raw("nation").join(Tables(spark, sf).raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rules = [rule(Atom("near", a, b), Atom("lies", a, r), Atom("lies", b, r)), rule(Atom("near", a, c), Atom("near", a, b), Atom("near", b, c)), rule(Atom("left_out", a), Atom("lies", a, "ASIA"))]
    s = search(_body(Atom("near", a, b)), [Atom("left_out", a)], [Atom("never", a)])
    session = Deduction(spark, rules, [s])
    session.insert("lies", names)
    session.advance(1)
    return session.candidates()[s].named()


@_query(f"{_CLOSURE} SELECT CAST(1 AS BIGINT) AS holds FROM r WHERE a = 0 AND b = 1")
def goal_nullary(spark, sf):
    rules = [_transitive(), rule(Atom("goal"), Atom("hop", 0, 1))]
    return _holds(saturate(spark, rules, {"hop": Tables(spark, sf).hop_bag()})["goal"])


@_query(f"{_CLOSURE} SELECT CAST(1 AS BIGINT) AS holds FROM r WHERE a = 0 AND b = 7")
def goal_nullary_twin(spark, sf):
    rules = [_transitive(), rule(Atom("goal"), Atom("hop", 0, 7))]
    return _holds(saturate(spark, rules, {"hop": Tables(spark, sf).hop_bag()})["goal"])


@_query("SELECT CAST(1 AS BIGINT) AS holds")
def no_antecedent(spark, sf):
    return _holds(saturate(spark, [rule(Atom("p"))], {})["p"])


@_query(f"WITH {_HOP} SELECT CAST(1 AS BIGINT) AS holds WHERE NOT EXISTS (SELECT 1 FROM hop WHERE a = b)")
def empty_key_suppression(spark, sf):
    (x,) = variables("x")
    s = search(Body([], []), [Atom("hop", x, x)])
    return _holds(candidates(spark, [s], {"hop": Tables(spark, sf).hop()})[s])


@_query(f"{_CLOSURE} SELECT a, b FROM r")
def epochs_insert(spark, sf):
    session = Deduction(spark, [_transitive()])
    t = Tables(spark, sf)
    half = (t.raw("lineitem").agg(F.max("l_orderkey")).first()[0] or 0) // 2
    session.insert("hop", t.hop(half).named("a", "b"))
    session.advance(1)
    session.insert("hop", t.hop().minus(t.hop(half)).named("a", "b"))
    session.advance(2)
    return session.facts("hop").named("a", "b")


@_query(f"""WITH RECURSIVE {_HOP}, kept AS (SELECT a, b FROM hop WHERE a >= 5),
  r(a, b) AS (SELECT a, b FROM kept UNION SELECT r.a, kept.b FROM r JOIN kept ON r.b = kept.a) SELECT a, b FROM r""")
def epochs_remove(spark, sf):
    session = Deduction(spark, [_transitive()])
    hop = Tables(spark, sf).hop().stored()
    session.insert("hop", hop.named("a", "b"))
    session.advance(1)
    session.remove("hop", hop.named("a", "b").where("a < 5"))
    session.advance(2)
    return session.facts("hop").named("a", "b")


@_query("""WITH kept AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag <> 'R'),
  served AS (SELECT DISTINCT o_custkey AS c, s FROM kept JOIN orders ON o = o_orderkey)
  SELECT 'sells' AS fact, CAST(s AS BIGINT) AS a, CAST(p AS BIGINT) AS b FROM (SELECT DISTINCT s, p FROM kept)
  UNION ALL SELECT 'served', CAST(c AS BIGINT), CAST(s AS BIGINT) FROM served""")
def epochs_retract(spark, sf):
    """Returned lines are taken back in a second epoch: what only they support falls, what other lines support as well comes back."""
    t, (o, p, s, c) = Tables(spark, sf), variables("o p s c")
    session = Deduction(spark, [rule(Atom("sells", s, p), Atom("item", o, p, s)), rule(Atom("served", c, s), Atom("placed", c, o), Atom("item", o, p, s))])
    line = lambda keep: t.raw("lineitem").where(f"l_returnflag {keep} 'R'").select("l_orderkey", "l_partkey", "l_suppkey")
    session.insert("item", line("<>").unionByName(line("=")))
    session.insert("placed", t["placed"].named("c", "o"))
    session.advance(1)
    session.remove("item", line("="))
    session.advance(2)
    named = lambda name: session.facts(name).named("a", "b").select(F.lit(name).alias("fact"), "a", "b")
    return named("sells").unionByName(named("served"))


@_query(f"WITH {_HOP} SELECT x.a AS x, y.b AS z FROM hop x JOIN hop y ON x.b = y.a")
def capture_bag(spark, sf):
    x, y, z = variables("x y z")
    return lower(plan_body(Body([x, z], [Atom("hop", x, y), Atom("hop", y, z)]), {"hop": 2}), {"hop": Tables(spark, sf).hop()}, spark).named()


@_query(f"""WITH {_HOP}, lacking AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM hop h WHERE NOT EXISTS
  (SELECT 1 FROM hop p JOIN hop q ON p.b = q.a WHERE p.a = h.a AND q.b = h.b))
  SELECT a, CAST(1000000 + k AS BIGINT) AS b FROM lacking UNION ALL SELECT CAST(1000000 + k AS BIGINT), b FROM lacking""")
def skolem_instances(spark, sf):
    """For each candidate a fresh supplier in between, and the two edges through it."""
    x, z, y = variables("x z y")
    heads = Atom("hop", x, y), Atom("hop", y, z)
    s = search(_body(Atom("hop", x, z)), heads)
    found = skolemize(candidates(spark, [s], {"hop": Tables(spark, sf).hop_bag().packed()})[s], [y], 1_000_000).stored()
    first, second = (instantiate_head(found, h).named("a", "b") for h in heads)
    return first.unionByName(second)
