"""Queries over the TPC-H-like tables, one for each operator, with SQL that gives the same answers.

Individuals are strings with a prefix for their type.  Each relation is a DataFrame expression and
the same thing in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridia.functions.domains import between, value_concept
from veridia.functions.workload import case_chain, chain
from veridia.kb import KnowledgeBase
from veridia.plans.terms import BOTTOM, TOP, Access, And, Axioms, Not, Or, atleast, atmost, atom, inv, only, some
from veridia.sources import dig, tst
from veridia.sources.access import retrieval
from veridia.storage import new_path

#: name: (table, subject, object, condition)
ROLES = {
    "placed": ("orders", "c:o_custkey", "o:o_orderkey", None),
    "hasItemFrom": ("lineitem", "o:l_orderkey", "s:l_suppkey", None),
    "containsPart": ("lineitem", "o:l_orderkey", "p:l_partkey", None),
    "customerIn": ("customer", "c:c_custkey", "n:c_nationkey", None),
    "supplierIn": ("supplier", "s:s_suppkey", "n:s_nationkey", None),
    "inRegion": ("nation", "n:n_nationkey", "r:n_regionkey", None),
    "nextNation": ("nation", "n:n_nationkey", "n:n_nationkey + 1", "n_nationkey < 24"),
}
#: name: (table, individual, condition)
CONCEPTS = {
    "Urgent": ("orders", "o:o_orderkey", "o_orderpriority = '1-URGENT'"),
    "Open": ("orders", "o:o_orderkey", "o_orderstatus = 'O'"),
    "Fulfilled": ("orders", "o:o_orderkey", "o_orderstatus = 'F'"),
    "Wealthy": ("customer", "c:c_custkey", "c_acctbal > 5000"),
    "Returned": ("lineitem", "o:l_orderkey", "l_returnflag = 'R'"),
    "Stocked": ("supplier", "s:s_suppkey", "s_acctbal > 5000"),
    "Lead": ("supplier", "s:s_suppkey", "s_suppkey % 20 = 0"),
    "Target": ("nation", "n:n_nationkey", "n_nationkey = 20"),
    "Start": ("nation", "n:n_nationkey", "n_nationkey = 2"),
    "Good": ("labels", "d:doc_id", "quality = 1"),
    "not Good": ("labels", "d:doc_id", "quality = 0"),
    "Toxic": ("labels", "d:doc_id", "toxic = 1"),
}


def _parts(ind: str) -> tuple[str, str]:
    prefix, _, column = ind.partition(":")
    return prefix, column


def _duck(ind: str) -> str:
    prefix, column = _parts(ind)
    return f"'{prefix}:' || CAST({column} AS VARCHAR)"


def _spark(ind: str) -> str:
    prefix, column = _parts(ind)
    return f"concat('{prefix}:', cast({column} as string))"


def role_sql(name: str) -> str:
    table, s, o, where = ROLES[name]
    return f"(SELECT DISTINCT {_duck(s)} AS s, {_duck(o)} AS o FROM {table}" + (f" WHERE {where})" if where else ")")


def concept_sql(name: str) -> str:
    table, ind, where = CONCEPTS[name]
    return f"(SELECT DISTINCT {_duck(ind)} AS ind FROM {table} WHERE {where})"


def base(spark: SparkSession, sf_dir: str, *names: str) -> KnowledgeBase:
    """A knowledge base with the relations named."""
    kb = KnowledgeBase(spark)
    for name in names:
        if name in ROLES:
            table, s, o, where = ROLES[name]
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            kb.role(name, (df.where(where) if where else df).selectExpr(f"{_spark(s)} as s", f"{_spark(o)} as o"))
        else:
            table, ind, where = CONCEPTS[name]
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(f"{_spark(ind)} as ind")
            kb.concept(name.removeprefix("not "), df, positive=not name.startswith("not "))
    return kb


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


R, C = role_sql, concept_sql


@query(f"SELECT DISTINCT p.s AS ind FROM {R('placed')} p JOIN {C('Urgent')} u ON p.o = u.ind JOIN {R('hasItemFrom')} h ON p.o = h.s JOIN {C('Stocked')} t ON h.o = t.ind")
def nested_exists(spark, sf_dir):
    """Customers with an urgent order that has an item from a well-stocked supplier, as a named concept."""
    kb = base(spark, sf_dir, "placed", "hasItemFrom", "Urgent", "Stocked")
    kb.tell(Axioms().implies(some("placed", And(atom("Urgent"), some("hasItemFrom", atom("Stocked")))), atom("Served")))
    return kb.instances("Served")


@query(f"SELECT ind FROM {C('Urgent')}")
def concept_scan(spark, sf_dir):
    return base(spark, sf_dir, "Urgent").instances("Urgent")


@query(f"SELECT s, o FROM {R('placed')}")
def role_scan(spark, sf_dir):
    return base(spark, sf_dir, "placed").related("placed")


@query(f"SELECT o AS s, s AS o FROM {R('placed')}")
def role_inverse(spark, sf_dir):
    return base(spark, sf_dir, "placed").related(inv("placed"))


@query(f"SELECT s, o FROM {R('customerIn')} UNION SELECT s, o FROM {R('supplierIn')}")
def role_hierarchy(spark, sf_dir):
    kb = base(spark, sf_dir, "customerIn", "supplierIn")
    return kb.tell(Axioms().subrole("customerIn", "locatedIn").subrole("supplierIn", "locatedIn")).related("locatedIn")


@query(f"SELECT o AS s, s AS o FROM {R('inRegion')}")
def role_equivalence(spark, sf_dir):
    return base(spark, sf_dir, "inRegion").tell(Axioms().equal_roles("hasNation", inv("inRegion"))).related("hasNation")


@query(f"SELECT ind FROM {C('Urgent')} INTERSECT SELECT ind FROM {C('Open')}")
def concept_and(spark, sf_dir):
    return base(spark, sf_dir, "Urgent", "Open").instances(And(atom("Urgent"), atom("Open")))


@query(f"SELECT ind FROM {C('Urgent')} UNION SELECT ind FROM {C('Fulfilled')}")
def concept_or(spark, sf_dir):
    return base(spark, sf_dir, "Urgent", "Fulfilled").instances(Or(atom("Urgent"), atom("Fulfilled")))


@query(f"SELECT DISTINCT s AS ind FROM {R('placed')} WHERE o IN (SELECT ind FROM {C('Urgent')})")
def concept_exists(spark, sf_dir):
    return base(spark, sf_dir, "placed", "Urgent").instances(some("placed", atom("Urgent")))


@query(f"SELECT DISTINCT o AS ind FROM {R('placed')} WHERE s IN (SELECT ind FROM {C('Wealthy')})")
def forall_push(spark, sf_dir):
    kb = base(spark, sf_dir, "placed", "Wealthy")
    return kb.tell(Axioms().implies(atom("Wealthy"), only("placed", atom("Precious")))).instances("Precious")


@query(f"SELECT DISTINCT s AS ind FROM {R('placed')}")
def domain_of(spark, sf_dir):
    return base(spark, sf_dir, "placed").tell(Axioms().domain("placed", atom("Buyer"))).instances("Buyer")


@query(f"SELECT DISTINCT o AS ind FROM {R('hasItemFrom')}")
def range_of(spark, sf_dir):
    return base(spark, sf_dir, "hasItemFrom").tell(Axioms().range("hasItemFrom", atom("Seller"))).instances("Seller")


@query(f"SELECT s AS ind FROM {R('placed')} WHERE o IN (SELECT ind FROM {C('Urgent')}) GROUP BY s HAVING count(DISTINCT o) >= 3")
def atleast_n(spark, sf_dir):
    kb = base(spark, sf_dir, "placed", "Urgent")
    return kb.tell(Axioms().implies(atleast(3, "placed", atom("Urgent")), atom("Rushed"))).instances("Rushed")


@query(
    f"SELECT DISTINCT a.o AS ind FROM {R('hasItemFrom')} a JOIN {R('hasItemFrom')} b ON a.s = b.s AND a.o <> b.o "
    f"WHERE b.o IN (SELECT ind FROM {C('Lead')}) AND a.o NOT IN (SELECT ind FROM {C('Lead')})"
)
def atmost_neg(spark, sf_dir):
    """At most one lead supplier an order: beside a known one the others are not."""
    kb = base(spark, sf_dir, "hasItemFrom", "Lead")
    return kb.tell(Axioms().implies(TOP, atmost(1, "hasItemFrom", atom("Lead")))).instances(Not(atom("Lead")))


@query(f"SELECT 'at most 1 y: hasItemFrom(x, y)' AS what, s AS ind FROM {R('hasItemFrom')} GROUP BY s HAVING count(DISTINCT o) > 1")
def functional_conflicts(spark, sf_dir):
    return base(spark, sf_dir, "hasItemFrom").tell(Axioms().functional("hasItemFrom")).inconsistencies()


@query(f"SELECT ind FROM {C('not Good')}")
def negative_scan(spark, sf_dir):
    return base(spark, sf_dir, "Good", "not Good").instances(Not(atom("Good")))


@query(f"SELECT ind FROM {C('Open')}")
def disjoint_neg(spark, sf_dir):
    return base(spark, sf_dir, "Open", "Urgent").tell(Axioms().disjoint(atom("Open"), atom("Closed"), atom("Lost"))).instances(Not(atom("Lost")))


@query(f"SELECT ind FROM {C('not Good')} UNION SELECT ind FROM {C('Toxic')}")
def contrapositive(spark, sf_dir):
    """Nothing that isn't good, or is toxic, can be praised."""
    kb = base(spark, sf_dir, "Good", "not Good", "Toxic")
    return kb.tell(Axioms().implies(atom("Praised"), And(atom("Good"), Not(atom("Toxic"))))).instances(Not(atom("Praised")))


@query(f"SELECT count(*) > 0 AS result FROM {R('placed')} WHERE s = 'c:1'")
def instance_true(spark, sf_dir):
    return base(spark, sf_dir, "placed").tell(Axioms().domain("placed", atom("Buyer"))).instance("c:1", "Buyer")


@query("SELECT 1 = 2 AS result")
def instance_false(spark, sf_dir):
    return base(spark, sf_dir, "placed").tell(Axioms().domain("placed", atom("Buyer"))).instance("nobody", "Buyer")


@query(f"SELECT o AS ind FROM {R('placed')} WHERE s = 'c:1'")
def role_fillers(spark, sf_dir):
    return base(spark, sf_dir, "placed").fillers("c:1", "placed")


@query(f"SELECT s, o FROM {R('inRegion')}")
def related_pairs(spark, sf_dir):
    return base(spark, sf_dir, "inRegion").related("inRegion")


@query(f"SELECT ind FROM {C('Urgent')} UNION SELECT ind FROM {C('Open')} UNION SELECT 'o:extra'")
def mixed_sources(spark, sf_dir):
    """One concept from memory, a table and another access."""
    kb = base(spark, sf_dir, "Urgent")
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("veridia_orders")
    kb.bind(Access("Urgent", 1, query="SELECT concat('o:', cast(o_orderkey as string)) FROM veridia_orders WHERE o_orderstatus = 'O'"))
    return kb.tell(Axioms().fact(atom("Urgent"), "o:extra")).instances("Urgent")


@query(f"SELECT ind FROM {C('Fulfilled')}")
def query_access(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("veridia_orders")
    access = Access("Done", 1, query="SELECT concat('o:', cast(o_orderkey as string)) FROM veridia_orders WHERE o_orderstatus = 'F'")
    return KnowledgeBase(spark).bind(access).instances("Done")


@query("SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS s, CAST(n_regionkey AS VARCHAR) AS o FROM nation")
def table_access(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("veridia_nation")
    return KnowledgeBase(spark).bind(Access("inRegion", 2, table=("veridia_nation", "n_nationkey", "n_regionkey"))).related("inRegion")


@query("SELECT DISTINCT 'o:' || CAST(o_orderkey AS VARCHAR) AS ind FROM orders WHERE NOT o_orderstatus = 'F'")
def negative_access(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("veridia_orders")
    access = Access("Done", 1, False, query="SELECT concat('o:', cast(o_orderkey as string)) FROM veridia_orders WHERE NOT o_orderstatus = 'F'")
    return KnowledgeBase(spark).bind(access).instances(Not(atom("Done")))


REACH = f"WITH RECURSIVE r AS (SELECT s, o FROM {R('nextNation')} UNION SELECT r.s, n.o FROM r JOIN {R('nextNation')} n ON r.o = n.s)"


@query(f"{REACH} SELECT s, o FROM r")
def transitive_closure(spark, sf_dir):
    return base(spark, sf_dir, "nextNation").tell(Axioms().trans("nextNation")).related("nextNation")


@query(f"{REACH} SELECT o AS ind FROM r WHERE s = 'n:3'")
def transitive_fillers(spark, sf_dir):
    """From one end, below another role: no other pair is derived."""
    kb = base(spark, sf_dir, "nextNation")
    return kb.tell(Axioms().subrole("nextNation", "before").trans("before").subrole("before", "linked")).fillers("n:3", "linked")


@query(f"{REACH} SELECT DISTINCT r.s AS x FROM r JOIN {C('Start')} t ON r.s = t.ind WHERE r.o = 'n:20'")
def transitive_bound_end(spark, sf_dir):
    kb = base(spark, sf_dir, "nextNation", "Start")
    return kb.tell(Axioms().trans("nextNation")).query(["?x"], [("nextNation", "?x", "n:20"), ("Start", "?x")])


@query(f"{REACH} SELECT DISTINCT s AS ind FROM r WHERE o IN (SELECT ind FROM {C('Target')})")
def transitive_reach(spark, sf_dir):
    kb = base(spark, sf_dir, "nextNation", "Target")
    return kb.tell(Axioms().subrole("nextNation", "before").trans("before").implies(some("before", atom("Target")), atom("Early"))).instances("Early")


@query(f"{REACH} SELECT DISTINCT o AS ind FROM r WHERE s IN (SELECT ind FROM {C('Start')}) UNION SELECT ind FROM {C('Start')}")
def transitive_inverse(spark, sf_dir):
    kb = base(spark, sf_dir, "nextNation", "Start")
    return kb.tell(Axioms().subrole("nextNation", "before").trans("before").implies(some(inv("before"), atom("Start")), atom("Start"))).instances("Start")


@query(f"{REACH} SELECT DISTINCT s AS ind FROM r WHERE o IN (SELECT ind FROM {C('Target')})")
def transitive_via_superrole(spark, sf_dir):
    kb = base(spark, sf_dir, "nextNation", "Target")
    told = Axioms().subrole("nextNation", "before").subrole("before", "linked").trans("before").implies(some("linked", atom("Target")), atom("Early"))
    return kb.tell(told).instances("Early")


@query(f"SELECT ind FROM {C('Wealthy')}")
def tbox_only_existential(spark, sf_dir):
    """Wealthy customers own something rare; owners of something rare are collectors. No such thing has a name."""
    kb = base(spark, sf_dir, "Wealthy")
    return kb.tell(Axioms().implies(atom("Wealthy"), some("owns", atom("Rare"))).implies(some("owns", atom("Rare")), atom("Collector"))).instances("Collector")


@query(f"SELECT ind FROM {C('Wealthy')}")
def tbox_counting(spark, sf_dir):
    """Three accounts, all Swiss, and at most two Swiss ones unless an insider."""
    told = Axioms().implies(atom("Wealthy"), And(atleast(3, "owns", atom("Account")), only("owns", atom("Swiss"))))
    return base(spark, sf_dir, "Wealthy").tell(told.implies(atmost(2, "owns", atom("Swiss")), atom("Outsider")).implies(TOP, Or(atom("Insider"), atmost(2, "owns", atom("Swiss"))))).instances("Insider")


SPLIT = f"{REACH} SELECT 'root' AS ind FROM r WHERE s IN (SELECT ind FROM {C('Start')}) AND o IN (SELECT ind FROM {C('Target')}) LIMIT 1"


@query(SPLIT)
def case_split_chain(spark, sf_dir):
    """A chain that begins in a concept and ends outside it has a step where it is left; which one is open."""
    kb = base(spark, sf_dir, "nextNation")
    kb.role("nextNation", spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("'root' as s", "concat('n:', cast(n_nationkey as string)) as o"))
    told = Axioms().equal(atom("Split"), some("nextNation", And(atom("In"), some("nextNation", Not(atom("In"))))))
    kb.concept("In", base(spark, sf_dir, "Start").instances("Start"))
    kb.concept("In", base(spark, sf_dir, "Target").instances("Target"), positive=False)
    return kb.tell(told).instances("Split")


@query(f"{REACH}, e AS (SELECT s, o FROM r UNION SELECT o, o FROM {R('nextNation')} UNION SELECT s, s FROM {R('nextNation')}) SELECT DISTINCT a.s AS ind FROM e a JOIN e b ON a.s = b.s WHERE a.o = 'n:6' AND b.o = 'n:20'")
def self_conflict_chain(spark, sf_dir):
    """Members pass membership on along the chain; 6 and 20 exclude each other: none up to 6 can be one."""
    kb = base(spark, sf_dir, "nextNation")
    told = Axioms().implies(some("nextNation", Not(atom("Member"))), Not(atom("Member"))).implies(some("excludes", atom("Member")), Not(atom("Member")))
    return kb.tell(told.related("n:6", "excludes", "n:20")).instances(Not(atom("Member")))


@query("SELECT 'i' || CAST(i AS VARCHAR) AS ind FROM range(0, 1) t(i)")
def generated_chain(spark, sf_dir):
    """The generated workload: 300 parents, 3 friends each; the first is a friend of the last."""
    parent, friend = chain(spark, 300, 3)
    kb = KnowledgeBase(spark).role("hasParent", parent).role("hasFriend", friend)
    told = Axioms().implies(some("hasParent", Not(atom("Member"))), Not(atom("Member"))).implies(some("hasFriend", atom("Member")), Not(atom("Member")))
    return kb.tell(told).instances(Not(atom("Member")))


@query(
    f"WITH p AS (SELECT DISTINCT s AS ind FROM {R('placed')} WHERE o IN (SELECT ind FROM {C('Returned')})) "
    f"SELECT ind FROM p UNION SELECT ind FROM {C('Wealthy')} WHERE ind NOT IN (SELECT ind FROM p)"
)
def cases_by_component(spark, sf_dir):
    """Whoever buys is known or new; the known and the new are watched if wealthy; who returned is watched."""
    kb = base(spark, sf_dir, "placed", "Returned", "Wealthy")
    told = Axioms().implies(some("placed", atom("Returned")), atom("Watched"))
    told.implies(atom("Wealthy"), Or(atom("Known"), atom("New"))).implies(atom("Known"), atom("Watched")).implies(atom("New"), atom("Watched"))
    return kb.tell(told).instances("Watched")


@query(f"SELECT DISTINCT p.s AS c, h.o AS s FROM {R('placed')} p JOIN {R('hasItemFrom')} h ON p.o = h.s JOIN {C('Urgent')} u ON u.ind = p.o")
def conjunctive_2var(spark, sf_dir):
    return base(spark, sf_dir, "placed", "hasItemFrom", "Urgent").query(["?c", "?s"], [("placed", "?c", "?o"), ("Urgent", "?o"), ("hasItemFrom", "?o", "?s")])


@query(
    f"SELECT DISTINCT p.s AS c, p.o AS o, h.o AS s FROM {R('placed')} p JOIN {R('hasItemFrom')} h ON p.o = h.s JOIN {R('customerIn')} c ON c.s = p.s JOIN {R('supplierIn')} t ON t.s = h.o AND t.o = c.o"
)
def conjunctive_3var(spark, sf_dir):
    """Customer, order and supplier of one nation: a triangle."""
    kb = base(spark, sf_dir, "placed", "hasItemFrom", "customerIn", "supplierIn")
    return kb.query(["?c", "?o", "?s"], [("placed", "?c", "?o"), ("hasItemFrom", "?o", "?s"), ("customerIn", "?c", "?n"), ("supplierIn", "?s", "?n")])


@query(f"SELECT DISTINCT s AS c FROM {R('placed')} WHERE o IN (SELECT s FROM {R('hasItemFrom')} WHERE o IN (SELECT ind FROM {C('Stocked')}))")
def conjunctive_semi(spark, sf_dir):
    """Committed sub-goals: they only have to hold."""
    kb = base(spark, sf_dir, "placed", "hasItemFrom", "Stocked")
    return kb.query(["?c"], [("placed", "?c", "?o")], exists=[("hasItemFrom", "?o", "?s"), ("Stocked", "?s")])


@query(f"SELECT DISTINCT s AS ind FROM {R('placed')} WHERE o IN (SELECT ind FROM {C('Urgent')}) INTERSECT SELECT ind FROM {C('Wealthy')}")
def complex_concept(spark, sf_dir):
    return base(spark, sf_dir, "placed", "Urgent", "Wealthy").instances(And(atom("Wealthy"), some("placed", atom("Urgent"))))


@query(f"SELECT s AS ind FROM {R('placed')} UNION SELECT o FROM {R('placed')} UNION SELECT ind FROM {C('Stocked')}")
def all_individuals(spark, sf_dir):
    return base(spark, sf_dir, "placed", "Stocked").individuals()


@query(
    f"SELECT 'Urgent' AS concept FROM {C('Urgent')} WHERE ind = 'o:1' UNION SELECT 'Open' FROM {C('Open')} WHERE ind = 'o:1' "
    f"UNION SELECT 'Fulfilled' FROM {C('Fulfilled')} WHERE ind = 'o:1' UNION SELECT 'Bought' FROM {R('placed')} WHERE o = 'o:1'"
)
def types_of(spark, sf_dir):
    kb = base(spark, sf_dir, "Urgent", "Open", "Fulfilled", "placed")
    return kb.tell(Axioms().range("placed", atom("Bought"))).types("o:1")


@query(f"SELECT 'Open' AS what, ind FROM {C('Open')} WHERE ind IN (SELECT ind FROM {C('Urgent')}) UNION SELECT 'Urgent', ind FROM {C('Open')} WHERE ind IN (SELECT ind FROM {C('Urgent')})")
def inconsistency_report(spark, sf_dir):
    return base(spark, sf_dir, "Open", "Urgent").tell(Axioms().disjoint(atom("Open"), atom("Urgent"))).inconsistencies()


@query("SELECT * FROM (VALUES ('Dog', 'Animal'), ('Dog', 'Pet'), ('Pet', 'Animal'), ('Hound', 'Dog'), ('Hound', 'Animal'), ('Hound', 'Pet'), ('Dog', 'Hound')) t(below, above)")
def taxonomy(spark, sf_dir):
    told = Axioms().implies(atom("Dog"), atom("Pet")).implies(atom("Pet"), And(atom("Animal"), some("owner", TOP))).equal(atom("Dog"), atom("Hound"))
    t = KnowledgeBase(spark).tell(told).taxonomy()
    return spark.createDataFrame([(d, c) for d in t for c in t[d]], "below string, above string")


@query("SELECT * FROM (VALUES ('clash', false), ('fine', true), ('subsumes', true), ('disjoint', true)) t(question, result)")
def satisfiability(spark, sf_dir):
    told = Axioms().implies(atom("A"), some("r", atom("B"))).implies(atom("A"), only("r", Not(atom("B")))).implies(atom("C"), some("r", atom("B"))).disjoint(atom("C"), atom("D"))
    kb = KnowledgeBase(spark).tell(told)
    rows = [("clash", kb.satisfiable("A")), ("fine", kb.satisfiable("C")), ("subsumes", kb.subsumes(some("r", TOP), "C")), ("disjoint", kb.disjoint("C", "D"))]
    return spark.createDataFrame(rows, "question string, result boolean")


@query("SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS ind FROM customer WHERE NOT (c_acctbal >= 1000 AND c_acctbal <= 5000)")
def value_range(spark, sf_dir):
    """Values as a concept with known insides and outsides."""
    kb = KnowledgeBase(spark)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    value_concept(kb, "Middling", customer, F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), between(F.col("c_acctbal"), 1000, 5000))
    return kb.instances(Not(atom("Middling")))


# ---- ground atoms, products, tests -----------------------------------------------------------------


@query(f"SELECT ind AS s FROM {C('Stocked')} WHERE EXISTS (SELECT 1 FROM {R('inRegion')} WHERE s = 'n:1' AND o = 'r:1')")
def conjunctive_ground(spark, sf_dir):
    return base(spark, sf_dir, "Stocked", "inRegion").query(["?s"], [("inRegion", "n:1", "r:1"), ("Stocked", "?s")])


@query(f"SELECT a.ind AS a, b.s AS b FROM {C('Lead')} a, {R('inRegion')} b WHERE b.o = 'r:2'")
def conjunctive_product(spark, sf_dir):
    """Two answer variables that nothing connects."""
    return base(spark, sf_dir, "Lead", "inRegion").query(["?a", "?b"], [("Lead", "?a"), ("inRegion", "?b", "r:2")])


@query(f"SELECT s AS n FROM {R('inRegion')} WHERE EXISTS (SELECT 1 FROM {C('Lead')} l JOIN {C('Stocked')} k ON l.ind = k.ind)")
def conjunctive_unshared(spark, sf_dir):
    """A committed sub-goal that shares no variable with the answer."""
    kb = base(spark, sf_dir, "inRegion", "Lead", "Stocked")
    return kb.query(["?n"], [("inRegion", "?n", "?r")], exists=[("Lead", "?z"), ("Stocked", "?z")])


@query(f"SELECT count(*) > 0 AS result FROM {C('Urgent')} u JOIN {R('placed')} p ON p.o = u.ind JOIN {C('Wealthy')} w ON w.ind = p.s")
def conjunctive_boolean(spark, sf_dir):
    return base(spark, sf_dir, "Urgent", "placed", "Wealthy").query([], [("Urgent", "?o"), ("placed", "?c", "?o"), ("Wealthy", "?c")])


@query(f"SELECT DISTINCT 'at most 0 y: hasItemFrom(x, y)' AS what, s AS ind FROM {R('hasItemFrom')}")
def inconsistency_bottom(spark, sf_dir):
    """What has an item from someone can't exist."""
    return base(spark, sf_dir, "hasItemFrom").tell(Axioms().implies(some("hasItemFrom"), BOTTOM)).inconsistencies()


# ---- sources ---------------------------------------------------------------------------------------


def _views(spark, sf_dir, *tables):
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"veridia_{t}")


@query("SELECT DISTINCT CAST(r_regionkey AS VARCHAR) AS ind FROM region")
def table_concept(spark, sf_dir):
    _views(spark, sf_dir, "region")
    return KnowledgeBase(spark).bind(Access("Region", 1, table=("veridia_region", "r_regionkey"))).instances("Region")


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS s, CAST(c_nationkey AS VARCHAR) AS o FROM customer WHERE c_acctbal > 5000")
def query_role(spark, sf_dir):
    _views(spark, sf_dir, "customer")
    return KnowledgeBase(spark).bind(Access("livesIn", 2, query="SELECT c_custkey, c_nationkey FROM veridia_customer WHERE c_acctbal > 5000")).related("livesIn")


@query("SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS ind FROM supplier WHERE s_suppkey = 3")
def four_queries(spark, sf_dir):
    """A role with a query for each binding pattern; one serves all."""
    _views(spark, sf_dir, "supplier")
    free = "SELECT s_suppkey, s_nationkey FROM veridia_supplier"
    found = retrieval(f"{free} WHERE s_suppkey = ? AND s_nationkey = ?", f"{free} WHERE s_suppkey = ?", f"{free} WHERE s_nationkey = ?", free)
    return KnowledgeBase(spark).bind(Access("sits", 2, query=found)).fillers("3", "sits")


TERM_FILE = """
% orders that are done, and those that aren't, from two queries; customers with a done order are served
dbConnection(db, source).
dbAccess('Done'/1, db, query('SELECT concat("o:", o_orderkey) FROM veridia_orders WHERE o_orderstatus = "F"')).
dbAccess(not('Done')/1, db, query('SELECT concat("o:", o_orderkey) FROM veridia_orders WHERE o_orderstatus = "O"')).
dbAccess(placed/2, db, query('SELECT concat("c:", o_custkey), concat("o:", o_orderkey) FROM veridia_orders')).
equiv(and([some(arole(placed), aconcept('Done'))]), aconcept('Served')).
implies(aconcept('Closed'), aconcept('Done')).
"""


@query(f"SELECT DISTINCT s AS ind FROM {R('placed')} WHERE o IN (SELECT ind FROM {C('Fulfilled')})")
def term_file(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return KnowledgeBase(spark).tell(tst.parse(TERM_FILE).axioms).instances("Served")


@query(f"SELECT ind FROM {C('Open')}")
def query_pair(spark, sf_dir):
    """The negative one of a pair of accesses, through an inclusion."""
    _views(spark, sf_dir, "orders")
    return KnowledgeBase(spark).tell(tst.parse(TERM_FILE).axioms).instances(Not(atom("Closed")))


XML_TELLS = """<tells xmlns="http://dl.kr.org/dig/2003/02/lang"><defconcept name="Big"/><defrole name="placed"/><deffeature name="customerIn"/>
<impliesc><some><feature name="customerIn"/><catom name="Target"/></some><catom name="Local"/></impliesc>
<impliesc><and><catom name="Local"/><some><ratom name="placed"/><catom name="Urgent"/></some></and><catom name="Big"/></impliesc>
<range><feature name="customerIn"/><catom name="Land"/></range><equalr><ratom name="placedBy"/><inverse><ratom name="placed"/></inverse></equalr></tells>"""


@query(
    f"SELECT DISTINCT p.s AS ind FROM {R('placed')} p JOIN {R('customerIn')} c ON c.s = p.s "
    f"WHERE p.o IN (SELECT ind FROM {C('Urgent')}) AND c.o IN (SELECT ind FROM {C('Target')})"
)
def xml_request(spark, sf_dir):
    kb = base(spark, sf_dir, "placed", "customerIn", "Urgent", "Target")
    return kb.tell(dig.parse(XML_TELLS).axioms).instances("Big")


@query(f"SELECT s AS ind FROM {R('customerIn')} WHERE o IN (SELECT ind FROM {C('Target')})")
def feature_exists(spark, sf_dir):
    return base(spark, sf_dir, "customerIn", "Target").tell(dig.parse(XML_TELLS).axioms).instances("Local")


@query(f"SELECT DISTINCT o AS ind FROM {R('customerIn')}")
def xml_answers(spark, sf_dir):
    """The answer document of a request, read back."""
    import xml.etree.ElementTree as ET

    kb = base(spark, sf_dir, "customerIn", "placed", "Urgent", "Target")
    dig.execute(kb, XML_TELLS)
    told = ET.fromstring(dig.execute(kb, '<asks xmlns="http://dl.kr.org/dig/2003/02/lang"><instances id="q"><catom name="Land"/></instances></asks>'))
    names = [e.get("name") for e in told.iter() if e.tag.rsplit("}", 1)[-1] == "individual"]
    return spark.createDataFrame([(n,) for n in names], "ind string")


@query(f"SELECT DISTINCT s AS ind FROM {R('placed')} WHERE o IN (SELECT ind FROM {C('Urgent')})")
def written_terms(spark, sf_dir):
    """Axioms written as a request, read, written as a term file and read again."""
    told = Axioms().implies(some("placed", atom("Urgent")), atom("Rushed")).disjoint(atom("Rushed"), atom("Calm"))
    again = tst.parse(tst.write(dig.parse(dig.write_tells(told)).axioms)).axioms
    return base(spark, sf_dir, "placed", "Urgent").tell(again).instances("Rushed")


@query("SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS a, CAST(r_regionkey AS VARCHAR) AS b FROM nation, region WHERE n_regionkey = r_regionkey")
def two_connections(spark, sf_dir):
    """Two databases with one table name."""
    read = lambda table: lambda s, name, query: s.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr("*", "1 as one")
    kb = KnowledgeBase(spark).connect("lands", read("nation")).connect("parts", read("region"))
    kb.bind(Access("Land", 1, table=("main", "n_nationkey"), connection="lands")).bind(Access("Part", 1, table=("main", "r_regionkey"), connection="parts"))
    kb.bind(Access("of", 2, table=("main", "n_nationkey", "n_regionkey"), connection="lands"))
    return kb.query(["?a", "?b"], [("Land", "?a"), ("of", "?a", "?b"), ("Part", "?b")])


@query(f"SELECT o AS value FROM {R('customerIn')} WHERE s = 'c:2'")
def told_values(spark, sf_dir):
    return base(spark, sf_dir, "customerIn").told_values("c:2", "customerIn")


@query(f"SELECT 'Urgent' AS pred, ind FROM {C('Urgent')} UNION SELECT 'Rushed', ind FROM {C('Urgent')}")
def materialised(spark, sf_dir):
    """What is entailed, written by predicate and read back."""
    kb, path = base(spark, sf_dir, "Urgent").tell(Axioms().implies(atom("Urgent"), atom("Rushed"))), new_path(spark, "entailed")
    kb.materialise(path, ["Urgent", "Rushed"], [])
    return spark.read.parquet(f"{path}/concepts").select("pred", "ind")


@query(f"SELECT 0 AS ask, ind FROM {C('Lead')} UNION SELECT 2, s FROM {R('inRegion')} WHERE o = 'r:1'")
def batch_of_asks(spark, sf_dir):
    """Several asks at once; the one that can't be answered doesn't stop the others."""
    kb = base(spark, sf_dir, "Lead", "inRegion")
    asks = [lambda k: k.instances("Lead"), lambda k: k.query(["?x"], [("Lead", "?y")]), lambda k: k.fillers("r:1", inv("inRegion"))]
    found = [(i, a) for i, a in enumerate(kb.ask_all(asks)) if isinstance(a, DataFrame)]
    parts = [a.select(F.lit(i).alias("ask"), "ind") for i, a in found]
    return parts[0].union(parts[1])


@query("SELECT * FROM (VALUES ('in', 'near'), ('in', 'linked'), ('near', 'linked')) t(below, above)")
def role_taxonomy(spark, sf_dir):
    kb = KnowledgeBase(spark).tell(Axioms().subrole("in", "near").subrole("near", "linked").equal_roles("linked", inv("links")))
    rows = [(r, s[0]) for r in ("in", "near", "linked") for s in kb.role_ancestors(r) if not s[1] and s[0] != "links"]
    return spark.createDataFrame(rows, "below string, above string")


CHAIN = 1000


@query(
    f"WITH RECURSIVE e AS (SELECT i FROM range(1, {CHAIN + 1}) t(i)), r AS (SELECT 1 AS i UNION SELECT r.i + 1 FROM r JOIN e ON e.i = r.i + 1) "
    f"SELECT 'root' AS ind FROM r WHERE i = {CHAIN}"
)
def case_split_generated(spark, sf_dir):
    """The chain family at size: whoever is inside at its begin and outside at its end has left somewhere."""
    edges = case_chain(spark, CHAIN)
    told = Axioms().equal(atom("Split"), some("child", And(atom("In"), some("child", Not(atom("In"))))))
    return KnowledgeBase(spark).role("child", edges).tell(told.fact(atom("In"), "i1").fact(Not(atom("In")), f"i{CHAIN}")).instances("Split")
