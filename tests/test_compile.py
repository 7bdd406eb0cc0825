"""Compilation against brute force: finite models over two or three elements."""

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from veridia.plans.program import Program
from veridia.plans.terms import BOTTOM, TOP, And, Axioms, Not, Or, atleast, atmost, atom, inv, only, role, some

A, B = atom("A"), atom("B")


def holds(c, x, domain, conc, rel):
    kind = c[0]
    if kind == "top":
        return True
    if kind == "bottom":
        return False
    if kind == "atom":
        return x in conc[c[1]]
    if kind == "not":
        return not holds(c[1], x, domain, conc, rel)
    if kind == "and":
        return all(holds(d, x, domain, conc, rel) for d in c[1])
    if kind == "or":
        return any(holds(d, x, domain, conc, rel) for d in c[1])
    name, inverted = c[2]
    near = [y for y in domain if ((y, x) if inverted else (x, y)) in rel[name]]
    n = sum(holds(c[3], y, domain, conc, rel) for y in near)
    return n >= c[1] if kind == "min" else n <= c[1]


def models(size):
    domain = range(size)
    pairs = list(product(domain, domain))
    for a in product([0, 1], repeat=size):
        for b in product([0, 1], repeat=size):
            for r in product([0, 1], repeat=len(pairs)):
                yield domain, {"A": {x for x in domain if a[x]}, "B": {x for x in domain if b[x]}}, {"r": {p for p, v in zip(pairs, r) if v}}


SMALL = [m for n in (1, 2) for m in models(n)]

concepts = st.recursive(
    st.sampled_from([TOP, BOTTOM, A, B]),
    lambda c: st.one_of(
        c.map(Not),
        st.tuples(c, c).map(lambda p: And(*p)),
        st.tuples(c, c).map(lambda p: Or(*p)),
        st.tuples(st.sampled_from([some, only]), st.sampled_from([role("r"), inv("r")]), c).map(lambda p: p[0](p[1], p[2])),
        st.tuples(st.sampled_from([atleast, atmost]), st.integers(1, 2), st.sampled_from([role("r"), inv("r")]), c).map(lambda p: p[0](p[1], p[2], p[3])),
    ),
    max_leaves=4,
)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.tuples(concepts, concepts), min_size=1, max_size=2), concepts)
def test_unsatisfiable_only_if_no_small_model_has_it(axioms, asked):
    told = Axioms()
    for c, d in axioms:
        told.implies(c, d)
    p = Program(told, [(atom("Q"), asked)])
    says_no = bool(_no_element(p)) or p.unsatisfiable("Q")
    for domain, conc, rel in SMALL:
        if all(not holds(c, x, domain, conc, rel) or holds(d, x, domain, conc, rel) for c, d in axioms for x in domain):
            if any(holds(asked, x, domain, conc, rel) for x in domain):
                assert not says_no
                return


def _no_element(p):
    try:
        p.check()
    except Exception:
        return True
    return False


def test_known_contradictions():
    cases = [
        (Axioms().implies(A, some("r", B)).implies(A, only("r", Not(B))), True),
        (Axioms().implies(A, atleast(3, "r", B)).implies(A, atmost(2, "r", B)), True),
        (Axioms().implies(A, And(some("r", B), some("r", Not(B)))).functional("r"), True),
        (Axioms().implies(A, And(some("r", B), some("r", Not(B)))).implies(TOP, atmost(2, "r")), False),
        (Axioms().implies(A, some("r", only(inv("r"), Not(A)))), True),
        (Axioms().implies(A, some("r", A)), False),
        (Axioms().implies(A, some("s", B)).subrole("s", "r").implies(A, only("r", Not(B))), True),
        (Axioms().implies(A, some("r", some("r", B))).trans("r").implies(A, only("r", Not(B))), True),
    ]
    for axioms, clash in cases:
        assert Program(axioms).unsatisfiable("A") == clash


# ---- instances: ground rules against models over the named individuals and one more --------------

FACTS = st.lists(st.tuples(st.sampled_from("AB"), st.booleans(), st.sampled_from("ab")), max_size=2)
EDGES = st.lists(st.tuples(st.just("r"), st.sampled_from("ab"), st.sampled_from("ab")), max_size=2)


def entailed(program, facts, edges, goal):
    """The rules, grounded on the individuals, and the negated goal have no model."""
    from veridia.operators.refute import Solver

    number = {}

    def lit(name, ind, positive):
        a = number.setdefault((name, ind), len(number) + 1)
        return a if positive else -a

    pairs, clauses = {(s, o) for _, s, o in edges}, []
    for r in program.rules:
        for x in "ab":
            unary = [lit(k[0], x, k[1]) for k in r.unary]
            if r.modal is None:
                clauses.append((unary, [], 0))
                continue
            n, (_, inverted), filler = r.modal
            near = [y for y in "ab" if ((y, x) if inverted else (x, y)) in pairs]
            if filler is None:
                clauses += [(unary, [], 0)] if len(near) > n else []
            elif n == 0:
                clauses += [([*unary, lit(filler[0], y, not filler[1])], [], 0) for y in near]
            elif len(near) > n:
                clauses.append((unary, [lit(filler[0], y, filler[1]) for y in near], n))
    clauses += [([lit(n, i, p)], [], 0) for n, p, i in facts] + [([-lit(*goal)], [], 0)]
    return any(not a and not b for a, b, _ in clauses) or Solver(clauses).model([]) is None


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.tuples(concepts, concepts), min_size=1, max_size=2), FACTS, EDGES, st.tuples(st.sampled_from("AB"), st.sampled_from("ab"), st.booleans()))
def test_no_model_contradicts_an_answer(axioms, facts, edges, goal):
    told = Axioms()
    for c, d in axioms:
        told.implies(c, d)
    if not entailed(Program(told), facts, edges, goal):
        return
    at = {"a": 0, "b": 1}
    for domain, conc, rel in models(2):
        if {(at[s], at[o]) for _, s, o in edges} <= rel["r"] and all((at[i] in conc[n]) == p for n, p, i in facts) and (at[goal[1]] in conc[goal[0]]) != goal[2]:
            assert not all(not holds(c, x, domain, conc, rel) or holds(d, x, domain, conc, rel) for c, d in axioms for x in domain)


def test_counting_below_restrictions_ends():
    """Terminologies with number restrictions under other restrictions: saturated to the end, at once."""
    r, back = role("r"), inv("r")
    for told in (
        Axioms().implies(B, some(r, atmost(2, r, A))),
        Axioms().implies(A, atmost(2, back, B)).implies(some(back, Not(B)), some(back, some(back))),
        Axioms().implies(TOP, some(back, Not(B))).implies(Not(A), Or(atmost(2, back, Not(A)), atleast(2, back, B))),
    ):
        p = Program(told)
        assert p.complete and len(p.rules) < 50


@settings(max_examples=300, deadline=3000, derandomize=True)
@given(st.lists(st.tuples(concepts, concepts), min_size=2, max_size=2))
def test_no_terminology_is_refused(axioms):
    told = Axioms()
    for c, d in axioms:
        told.implies(c, d)
    assert isinstance(Program(told).rules, list)
