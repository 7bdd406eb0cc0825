"""Recursion and contraction in one task against plain evaluation and against distributed rounds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridia.kb import KnowledgeBase
from veridia.operators import local, refute
from veridia.operators.components import connected_components, smallest
from veridia.operators.local import fixpoint
from veridia.plans.program import Rule
from veridia.plans.terms import And, Axioms, Not, atom, inv, some

R = ("r", False)
KEYS = [("A", True), ("B", True), ("C", True)]
negated = st.sampled_from(KEYS).map(lambda k: (k[0], False))
modal = st.tuples(st.integers(0, 2), st.just(R), st.one_of(st.none(), st.sampled_from(KEYS)))
rules = st.lists(st.tuples(st.sampled_from(KEYS), st.lists(negated, max_size=2, unique=True), st.one_of(st.none(), modal)), min_size=1, max_size=4)
node = st.integers(0, 5).map(str)


def plainly(made, facts, edges):
    """All facts, each round looking at every rule and individual anew."""
    facts = {k: set(v) for k, v in facts.items()}
    while True:
        before = sum(map(len, facts.values()))
        for head, rule, _ in made:
            for x in map(str, range(6)):
                near = {o for s, o in edges if s == x}
                n, _, filler = rule.modal or (-1, None, None)
                inside = near if filler is None else near & facts[filler]
                if len(inside) > n and all(x in facts[k[0], True] for k in rule.unary if k != head):
                    facts[head].add(x)
        if sum(map(len, facts.values())) == before:
            return facts


@settings(max_examples=300, deadline=None)
@given(rules, st.lists(st.tuples(st.sampled_from(KEYS), node), max_size=6), st.lists(st.tuples(node, node), max_size=10))
def test_rounds_in_memory(given_rules, told, edges):
    # a rule without a recursive literal is evaluated before the recursion begins
    made = [(h, Rule((h, *u), m), "x") for h, u, m in given_rules if h not in {(k[0], True) for k in u} and (u or (m and m[2]))]
    facts = {k: {i for j, i in told if j == k} for k in KEYS}
    assert fixpoint(made, facts, {}, {R: set(edges)}) == plainly(made, facts, edges)


def test_successors_beyond_the_bound_are_outside():
    rule = Rule((("A", False),), (1, R, ("B", True)))
    got = fixpoint([(("B", False), rule, "y")], {("B", False): set()}, {("A", True): {"a"}, ("B", True): {"x"}}, {R: {("a", "x"), ("a", "y"), ("b", "z")}})
    assert got == {("B", False): set()}  # nothing recursive is new, so the rule isn't looked at
    got = fixpoint([(("B", False), rule, "y")], {("B", False): set(), ("A", True): {"a"}}, {("B", True): {"x"}}, {R: {("a", "x"), ("a", "y"), ("b", "z")}})
    assert got[("B", False)] == {"y"}


def recursive(spark):
    told = Axioms().subrole("next", "before").trans("before").implies(some("before", atom("Target")), atom("Early"))
    told.implies(some(inv("before"), atom("Start")), atom("Start")).equal(atom("Split"), some("child", And(atom("In"), some("child", Not(atom("In"))))))
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n7"), ("m0", "m1")]
    kb = KnowledgeBase(spark).tell(told.fact(atom("Target"), "n4").fact(atom("Start"), "n2").fact(atom("In"), "c0").fact(Not(atom("In")), "c5"))
    kb.role("next", spark.createDataFrame(edges, "s string, o string"))
    kb.role("child", spark.createDataFrame([("root", f"c{i}") for i in range(6)] + [(f"c{i}", f"c{i + 1}") for i in range(5)], "s string, o string"))
    return {name: {r["ind"] for r in kb.instances(name).collect()} for name in ("Early", "Start", "Split")}


def test_same_answers_in_rounds(spark, monkeypatch):
    want = {"Early": {f"n{i}" for i in range(4)}, "Start": {f"n{i}" for i in range(2, 10)}, "Split": {"root"}}
    assert recursive(spark) == want
    monkeypatch.setattr(local, "SMALL", 0)
    monkeypatch.setattr(refute, "SMALL", 0)
    assert recursive(spark) == want


@pytest.mark.parametrize("small", [0, 12, 1000])
def test_components(spark, small):
    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7), (200, 201)]
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), small=small).collect()
    assert dict(map(tuple, got)) == smallest((u, v) for u, v in edges if u != v)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint"), small=5).collect() == []
