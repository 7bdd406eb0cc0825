"""Term files: axioms, facts, accesses, queries with expected answers, as Prolog-like terms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from veridia.plans.terms import BOTTOM, TOP, Access, And, Axioms, Concept, DLError, Not, Or, Role, atleast, atmost, atom, inv, only, role, some

from .access import retrieval

TOKEN = re.compile(r"\s+|%[^\n]*|/\*.*?\*/|(?P<q>'(?:[^'\\]|''|\\.)*')|(?P<n>-?\d+)|(?P<a>[A-Za-z_][A-Za-z0-9_]*)|(?P<p>[()\[\],./|:-])", re.S)


@dataclass(frozen=True)
class Term:
    name: str
    args: tuple = ()
    anonymous: bool = False


@dataclass
class Case:
    """A question and its expected answer (None: not stated). kind: instances, instance, fillers, pairs."""

    kind: str
    args: tuple
    expected: object


@dataclass
class TestFile:
    axioms: Axioms = field(default_factory=Axioms)
    cases: list[Case] = field(default_factory=list)
    options: list = field(default_factory=list)
    connections: list = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise DLError(f"unreadable at {text[at : at + 20]!r}", 101)
        at = m.end()
        if m["q"] is not None:
            out.append(("atom", re.sub(r"\\(.)", r"\1", m["q"][1:-1].replace("''", "'"))))
        elif m["n"] is not None:
            out.append(("int", int(m["n"])))
        elif m["a"] is not None:
            out.append(("var" if m["a"][0] == "_" or m["a"][0].isupper() else "atom", m["a"]))
        elif m["p"] is not None:
            out.append(("punct", m["p"]))
    return out


def terms(text: str) -> list:
    toks, at, out = tokens(text), 0, []

    def peek(v: str) -> bool:
        return at < len(toks) and toks[at] == ("punct", v)

    def take(v: str) -> None:
        nonlocal at
        if not peek(v):
            raise DLError(f"expected {v}", 101)
        at += 1

    def simple():
        nonlocal at
        if at >= len(toks):
            raise DLError("the file ends inside a term", 101)
        kind, v = toks[at]
        at += 1
        if (kind, v) == ("punct", "["):
            items = []
            while not peek("]"):
                items.append(term())
                if peek(","):
                    take(",")
            take("]")
            return items
        if (kind, v) == ("punct", "("):
            inner = term()
            take(")")
            return inner
        if kind == "int":
            return v
        if kind == "var":
            return Term(v, anonymous=True)
        if kind != "atom":
            raise DLError(f"unexpected {v}", 101)
        if peek("("):
            take("(")
            args = [term()]
            while peek(","):
                take(",")
                args.append(term())
            take(")")
            return Term(v, tuple(args))
        return Term(v)

    def term():
        left = simple()
        while peek("/") or peek("-"):
            op = toks[at][1]
            take(op)
            left = Term(op, (left, simple()))
        return left

    while at < len(toks):
        out.append(term())
        take(".")
    return out


def name_of(t) -> str:
    return str(t) if isinstance(t, int) else t.name


def role_of(t: Term) -> Role:
    return inv(role_of(t.args[0])) if t.name == "inv" else role(name_of(t.args[0]) if t.name in ("arole", "feature") else t.name)


def concept_of(t: Term) -> Concept:
    n, a = t.name, t.args
    if n in ("top", "bottom") and not a:
        return TOP if n == "top" else BOTTOM
    if n == "aconcept":
        return atom(name_of(a[0]))
    if n == "not":
        return Not(concept_of(a[0]))
    if n in ("and", "or"):
        return (And if n == "and" else Or)(*[concept_of(x) for x in a[0]])
    if n in ("some", "all"):
        return (some if n == "some" else only)(role_of(a[0]), concept_of(a[1]))
    if n in ("atleast", "atmost"):
        return (atleast if n == "atleast" else atmost)(a[0], role_of(a[1]), concept_of(a[2]) if len(a) > 2 else TOP)
    raise DLError(f"unknown concept {n}", 103)


def access_of(functor: Term, connection: Term, how: Term) -> Access:
    target, arity = functor.args
    positive = target.name != "not" or not target.args
    name = name_of(target if positive else target.args[0])
    if how.name == "table":
        columns = how.args[1].args if isinstance(how.args[1], Term) and how.args[1].name == "-" else how.args[1:]
        return Access(name, arity, positive, table=tuple(name_of(x) for x in (how.args[0], *columns)), connection=name_of(connection))
    return Access(name, arity, positive, query=retrieval(*[name_of(x) for x in how.args]), connection=name_of(connection))


def _case(q: Term, *expected) -> Case:
    given = expected[0] if expected else None
    unknown = isinstance(given, Term) and given.anonymous
    if q.name == "instances":
        return Case("instances", (concept_of(q.args[0]),), None if given is None or unknown else {name_of(x) for x in given})
    if q.name == "instance":
        return Case("instance", (name_of(q.args[0]), concept_of(q.args[1])), True if given is None else None if unknown else given.name == "true")
    if q.name == "roleFillers":
        return Case("fillers", (name_of(q.args[0]), role_of(q.args[1])), None if given is None or unknown else {name_of(x) for x in given})
    if q.name == "relatedIndividuals":
        return Case("pairs", (role_of(q.args[0]),), None if given is None or unknown else {tuple(name_of(y) for y in x.args) for x in given})
    raise DLError(f"unknown query {q.name}", 203)


def parse(text: str) -> TestFile:
    out = TestFile()
    ax = out.axioms
    for t in terms(text):
        n, a = t.name, t.args
        if n in ("concept", "concepts"):
            ax.concept_names += [name_of(x) for x in (a[0] if isinstance(a[0], list) else a)]
        elif n in ("role", "roles"):
            ax.role_names += [name_of(x) for x in (a[0] if isinstance(a[0], list) else a)]
        elif n == "implies":
            ax.implies(concept_of(a[0]), concept_of(a[1]))
        elif n == "equiv":
            ax.equal(concept_of(a[0]), concept_of(a[1]))
        elif n == "disjoint":
            ax.disjoint(*[concept_of(x) for x in (a[0] if isinstance(a[0], list) else a)])
        elif n == "subrole":
            ax.subrole(role_of(a[0]), role_of(a[1]))
        elif n == "transitive":
            ax.trans(role_of(a[0]))
        elif n == "cassertion" or n == "assertion" and len(a) == 2:
            ax.fact(concept_of(a[0]), name_of(a[1]))
        elif n in ("rassertion", "assertion"):
            ax.related(name_of(a[1]), role_of(a[0]), name_of(a[2]))
        elif n == "dbConnection":
            out.connections.append(tuple(name_of(x) for x in a))
        elif n == "dbAccess":
            ax.accesses.append(access_of(*a))
        elif n == "query":
            out.cases.append(_case(*a))
        elif n == "options":
            out.options.append(a[0])
        else:
            raise DLError(f"unknown term {n}", 101)
    return out


def read(path: str) -> TestFile:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


# ---- writing -----------------------------------------------------------------------------------


def quoted(name: str) -> str:
    return name if re.fullmatch(r"[a-z][A-Za-z0-9_]*", name) else "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def show_role(r: Role) -> str:
    return f"inv(arole({quoted(r[0])}))" if r[1] else f"arole({quoted(r[0])})"


def show(c: Concept) -> str:
    kind = c[0]
    if kind in ("top", "bottom"):
        return kind
    if kind == "atom":
        return f"aconcept({quoted(c[1])})"
    if kind == "not":
        return f"not({show(c[1])})"
    if kind in ("and", "or"):
        return f"{kind}([{', '.join(show(x) for x in c[1])}])"
    if kind == "min" and c[1] == 1:
        return f"some({show_role(c[2])}, {show(c[3])})"
    if kind == "max" and c[1] == 0:
        return f"all({show_role(c[2])}, {show(c[3][1] if c[3][0] == 'not' else Not(c[3]))})"
    return f"{'atleast' if kind == 'min' else 'atmost'}({c[1]}, {show_role(c[2])}, {show(c[3])})"


def write(axioms: Axioms) -> str:
    """The axioms as a term file (of an XML request, the converter's output)."""
    out = [f"concept({quoted(n)})." for n in axioms.concept_names] + [f"role({quoted(n)})." for n in axioms.role_names]
    out += [f"implies({show(c)}, {show(d)})." for c, d in axioms.concepts]
    out += [f"subrole({show_role(r)}, {show_role(s)})." for r, s in axioms.roles]
    out += [f"transitive({show_role(r)})." for r in axioms.transitive]
    out += [f"cassertion({show(atom(n) if p else Not(atom(n)))}, {quoted(i)})." for n, p, i in axioms.concept_facts]
    out += [f"cassertion(top, {quoted(i)})." for i in axioms.individuals]
    out += [f"rassertion(arole({quoted(n)}), {quoted(s)}, {quoted(o)})." for n, s, o in axioms.role_facts]
    return "\n".join(out) + "\n"
