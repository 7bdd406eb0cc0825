"""Concepts, roles and axioms.

A concept is a tuple: ("top",), ("bottom",), ("atom", name), ("not", c), ("and", (c, ...)),
("or", (c, ...)), ("min", n, role, c), ("max", n, role, c), ("one", (name, ...)).  A role is a pair
(name, inverted).
"""

from __future__ import annotations

from dataclasses import dataclass, field

Concept = tuple
Role = tuple[str, bool]

TOP: Concept = ("top",)
BOTTOM: Concept = ("bottom",)


class DLError(Exception):
    """An error with a protocol code."""

    code = 100

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        if code is not None:
            self.code = code


class UnsupportedConstruct(DLError):
    code = 103


class UnsupportedAxiom(DLError):
    code = 301


class UnsupportedAsk(DLError):
    code = 203


class InconsistentTBox(DLError):
    code = 400


def atom(name: str) -> Concept:
    return ("atom", name)


def Not(c: Concept) -> Concept:
    return ("not", c)


def And(*cs: Concept) -> Concept:
    return ("and", tuple(cs))


def Or(*cs: Concept) -> Concept:
    return ("or", tuple(cs))


def role(name: str) -> Role:
    return (name, False)


def inv(r: Role | str) -> Role:
    r = role(r) if isinstance(r, str) else r
    return (r[0], not r[1])


def _role(r: Role | str) -> Role:
    return role(r) if isinstance(r, str) else r


def some(r: Role | str, c: Concept = TOP) -> Concept:
    return ("min", 1, _role(r), c)


def only(r: Role | str, c: Concept) -> Concept:
    return ("max", 0, _role(r), Not(c))


def atleast(n: int, r: Role | str, c: Concept = TOP) -> Concept:
    return ("min", n, _role(r), c)


def atmost(n: int, r: Role | str, c: Concept = TOP) -> Concept:
    return ("max", n, _role(r), c)


@dataclass
class Axioms:
    """What a knowledge base is told. A role fact is (name, subject, object), a concept fact (name, positive, individual)."""

    concepts: list[tuple[Concept, Concept]] = field(default_factory=list)
    roles: list[tuple[Role, Role]] = field(default_factory=list)
    transitive: list[Role] = field(default_factory=list)
    concept_facts: list[tuple[str, bool, str]] = field(default_factory=list)
    role_facts: list[tuple[str, str, str]] = field(default_factory=list)
    individuals: list[str] = field(default_factory=list)
    concept_names: list[str] = field(default_factory=list)
    role_names: list[str] = field(default_factory=list)
    accesses: list[Access] = field(default_factory=list)
    _fresh: int = 0

    def implies(self, c: Concept, d: Concept) -> Axioms:
        self.concepts.append((c, d))
        return self

    def equal(self, c: Concept, d: Concept) -> Axioms:
        return self.implies(c, d).implies(d, c)

    def disjoint(self, *cs: Concept) -> Axioms:
        for i, c in enumerate(cs):
            for d in cs[i + 1 :]:
                self.implies(And(c, d), BOTTOM)
        return self

    def subrole(self, r: Role | str, s: Role | str) -> Axioms:
        self.roles.append((_role(r), _role(s)))
        return self

    def equal_roles(self, r: Role | str, s: Role | str) -> Axioms:
        return self.subrole(r, s).subrole(s, r)

    def domain(self, r: Role | str, c: Concept) -> Axioms:
        return self.implies(some(r), c)

    def range(self, r: Role | str, c: Concept) -> Axioms:
        return self.implies(TOP, only(r, c))

    def functional(self, r: Role | str) -> Axioms:
        return self.implies(TOP, atmost(1, r))

    def trans(self, r: Role | str) -> Axioms:
        self.transitive.append(_role(r))
        return self

    def fact(self, c: Concept, individual: str) -> Axioms:
        """A concept fact; a complex concept gets a name of its own below it."""
        if c[0] == "atom":
            self.concept_facts.append((c[1], True, individual))
        elif c[0] == "not" and c[1][0] == "atom":
            self.concept_facts.append((c[1][1], False, individual))
        elif c == TOP:
            self.individuals.append(individual)
        else:
            name = f"_fact{len(self.concept_facts)}"
            self.implies(atom(name), c)
            self.concept_facts.append((name, True, individual))
        return self

    def related(self, s: str, r: Role | str, o: str) -> Axioms:
        name, inverted = _role(r)
        self.role_facts.append((name, o, s) if inverted else (name, s, o))
        return self

    def merge(self, other: Axioms) -> Axioms:
        for k in ("concepts", "roles", "transitive", "concept_facts", "role_facts", "individuals", "concept_names", "role_names", "accesses"):
            getattr(self, k).extend(getattr(other, k))
        return self


@dataclass(frozen=True)
class Access:
    """An external relation of a concept (arity 1) or role (arity 2).

    table: (name, column) or (name, subject column, object column); query: SQL whose first one or
    two columns are the keys. Of a list of queries by binding pattern only the retrieval is needed,
    since a filter on its result reaches the source.
    """

    name: str
    arity: int
    positive: bool = True
    table: tuple[str, ...] | None = None
    query: str | None = None
    connection: str | None = None
