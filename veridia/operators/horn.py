"""Forward derivation: rules as semi-joins, unions and counts over facts.

Keys are evaluated in the order of their dependencies.  A key that doesn't depend on itself is a lazy
plan; keys that depend on each other run a semi-naive loop in which each round joins only the facts
that were new in the last one, and ends its lineage in a written table; where a count shows that they
read few rows, one task runs all rounds (`local`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridia.plans.program import Key, Program, Rule
from veridia.storage import materialise

from .local import gathered
from .roles import Roles

ROUNDS = 10_000
COMPACT = 16
#: Steps of a round where only one rule recurs, through one literal.
HOPS = 4


def union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.union, parts).distinct() if parts else None


def meet(frames: list[DataFrame]) -> DataFrame | None:
    """Individuals (ind) in all frames."""
    out = None
    for f in frames:
        out = f if out is None else out.join(f, "ind", "left_semi")
    return out


def strata(needed: dict[Key, list[tuple[Rule, str]]]) -> list[list[Key]]:
    """Strongly connected keys, those that others depend on first (Tarjan, without recursion)."""
    after = {k: sorted({b for r, at in rules for b in r.body(k, at)} & needed.keys()) for k, rules in needed.items()}
    index: dict[Key, int] = {}
    low: dict[Key, int] = {}
    stack: list[Key] = []
    on: set[Key] = set()
    out: list[list[Key]] = []
    for root in sorted(needed):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            k, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(after[b])))
                    break
                if b in on:
                    low[k] = min(low[k], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[k])
                if low[k] == index[k]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == k:
                            break
                    out.append(sorted(part))
    return out


class Horn:
    """told: facts by key (ind). individuals: a function that gives all individuals."""

    def __init__(self, program: Program, told: dict[Key, DataFrame], roles: Roles, individuals):
        self.program, self.told, self.roles, self.individuals = program, told, roles, individuals
        self.possible = program.possible(set(told), set(roles.stored))
        self.known: dict[Key, DataFrame] = {}

    def facts(self, k: Key) -> DataFrame | None:
        """All derivable facts of a key, or None if there can be none."""
        if k not in self.possible:
            return None
        if k not in self.known:
            for part in strata(self.program.needed([k], self.possible)):
                if part[0] not in self.known:
                    self._evaluate(part)
        return self.known[k]

    def _evaluate(self, part: list[Key]) -> None:
        needed = self.program.needed(part, self.possible)
        inside = set(part)
        first: dict[Key, list[DataFrame]] = {k: [self.told[k]] if k in self.told else [] for k in part}
        later: list[tuple[Key, Rule, str]] = []
        for k in part:
            for rule, at in needed[k]:
                if inside & set(rule.body(k, at)):
                    later.append((k, rule, at))
                else:
                    first[k].append(self.derive(rule, k, at, self.known))
        start = {k: union(first[k]) for k in part}
        if not later:
            self.known |= start
            return
        nothing = self.individuals().limit(0)
        total = {k: materialise(f if f is not None else nothing, "facts") for k, f in start.items()}
        if self._few(part, later, total):
            return
        new = dict(total)
        narrow = sum(len(set(rule.body(k, at)) & inside) for k, rule, at in later) == 1
        for turn in range(ROUNDS):
            new = {k: f for k, f in new.items() if not f.isEmpty()}
            if not new:
                break
            found: dict[Key, list[DataFrame]] = {}
            step = new
            for _ in range(HOPS if narrow else 1):  # a round of a narrow recursion takes several steps before it is written
                after: dict[Key, list[DataFrame]] = {}
                for k, rule, at in later:
                    for b in dict.fromkeys(rule.body(k, at)):
                        if b in step:
                            after.setdefault(k, []).append(self.derive(rule, k, at, self.known | total, changed=(b, step[b])))
                step = {k: union(parts) for k, parts in after.items()}
                for k, f in step.items():
                    found.setdefault(k, []).append(f)
            new = {k: materialise(union(parts).join(total[k], "ind", "left_anti"), "facts") for k, parts in found.items()}
            total = {k: total[k].union(new[k]) if k in new else total[k] for k in total}
            if turn % COMPACT == COMPACT - 1:  # one table again, so that plans stay small on long chains
                total = {k: materialise(f, "facts") for k, f in total.items()}
        else:
            raise RuntimeError(f"no fixpoint in {ROUNDS} rounds")
        self.known |= total

    def _few(self, part: list[Key], later: list[tuple[Key, Rule, str]], total: dict[Key, DataFrame]) -> bool:
        """Evaluates the part in one task if it reads few rows."""
        given = {b: self.known[b] for k, rule, at in later for b in rule.body(k, at) if b not in total}
        pairs = {rule.modal[1]: self.roles.edges(rule.modal[1]) for _, rule, _ in later if rule.modal}
        found = gathered(later, total, given, pairs)
        if found is None:
            return False
        found = materialise(found, "facts")
        self.known |= {k: found.where(F.col("k") == i).select("ind") for i, k in enumerate(total)}
        return True

    def derive(self, rule: Rule, head: Key, at: str, known: dict[Key, DataFrame], changed: tuple[Key, DataFrame] | None = None) -> DataFrame:
        """New instances of the head; changed: one key whose facts are replaced by its new ones. Counts need all facts."""

        def get(k: Key, counting: bool = False) -> DataFrame:
            return changed[1] if changed and k == changed[0] and not counting else known[k]

        unary = [(k[0], not k[1]) for k in rule.unary if not (at == "x" and k == head)]
        frames = [get(k) for k in unary]
        if rule.modal is None:
            out = meet(frames)
            return (out if out is not None else self.individuals()).distinct()
        n, r, filler = rule.modal
        edges = self.roles.edges(r)
        if at == "y" and n == 0:
            x = meet(frames)
            if x is not None:
                edges = edges.join(x.withColumnRenamed("ind", "s"), "s", "left_semi")
            return edges.select(F.col("o").alias("ind")).distinct()
        inside = edges if filler is None else edges.join(get(filler, counting=n > 0).withColumnRenamed("ind", "o"), "o", "left_semi")
        if n == 0:
            met = inside.select(F.col("s").alias("ind")).distinct()
        else:
            least = n + 1 if at == "x" else n
            met = inside.groupBy("s").agg(F.count_distinct("o").alias("n")).where(F.col("n") >= least).select(F.col("s").alias("ind"))
        out = meet([*frames, met])
        if at == "x":
            return out.distinct()
        # n successors are in the filler already: all others are outside, since names are unique
        full = edges.join(out.withColumnRenamed("ind", "s"), "s", "left_semi")
        return full.select(F.col("o").alias("ind")).distinct().join(known[filler], "ind", "left_anti")
