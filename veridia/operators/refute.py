"""Proof by contradiction over ground clauses.

What forward derivation leaves open is grounded: one clause for each rule and individual or edge, with
literals that are known false removed and clauses with a known true one dropped.  Clauses that share
an atom form components; each is solved on its own, in parallel: an individual is an instance of the
goal if the component has no model in which it isn't (unit propagation, then complete search).
A component without any model is inconsistent; it gives no answers beyond the derived ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridia.plans.program import Key, Rule
from veridia.storage import materialise

from .components import connected_components
from .horn import Horn
from .local import SMALL


class Solver:
    """Clauses (literals, counted, bound): a literal holds, or at most `bound` of the counted ones do.
    Literals are non-zero integers, negative for negated atoms."""

    def __init__(self, clauses: list[tuple[list[int], list[int], int]]):
        self.clauses = clauses
        self.where: dict[int, list[int]] = {}
        for i, (lits, counted, _) in enumerate(clauses):
            for p in {abs(p) for p in (*lits, *counted)}:
                self.where.setdefault(p, []).append(i)
        self.order = sorted(self.where, key=lambda a: -len(self.where[a]))
        self.settled: list[dict[int, bool] | None] = []

    def propagate(self, value: dict[int, bool], todo: list[int], trail: list[int]) -> bool:
        """Sets the literals of todo and all that follows; False on a contradiction."""
        while todo:
            p = todo.pop()
            a, v = abs(p), p > 0
            if a in value:
                if value[a] != v:
                    return False
                continue
            value[a] = v
            trail.append(a)
            for i in self.where.get(a, ()):
                if not self._look(i, value, todo):
                    return False
        return True

    def _look(self, i: int, value: dict[int, bool], todo: list[int]) -> bool:
        lits, counted, bound = self.clauses[i]
        free = []
        for p in lits:
            v = value.get(abs(p))
            if v is None:
                free.append(p)
            elif v == (p > 0):
                return True
        if not counted:
            if not free:
                return False
            if len(free) == 1:
                todo.append(free[0])
            return True
        true = sum(value.get(abs(p)) == (p > 0) for p in counted)
        open_ = [p for p in counted if abs(p) not in value]
        if true > bound:
            if not free:
                return False
            if len(free) == 1:
                todo.append(free[0])
        elif true == bound and not free:
            todo += [-p for p in open_]
        return True

    def settle(self) -> dict[int, bool] | None:
        """What follows without any assumption; None if the clauses contradict each other at once."""
        if not self.settled:
            value: dict[int, bool] = {}
            start: list[int] = []
            fine = all(self._look(i, value, start) for i in range(len(self.clauses))) and self.propagate(value, start, [])
            self.settled = [value if fine else None]
        return self.settled[0]

    def model(self, assumed: list[int]) -> dict[int, bool] | None:
        given = self.settle()
        if given is None:
            return None
        value = dict(given)
        if not self.propagate(value, list(assumed), []):
            return None
        stack: list[tuple[list[int], int, bool, int]] = []  # trail, atom, was the other value tried, place
        k = 0
        while True:
            while k < len(self.order) and self.order[k] in value:
                k += 1
            if k == len(self.order):
                return value
            decided, v, tried = self.order[k], False, False
            while True:
                trail: list[int] = []
                if self.propagate(value, [decided if v else -decided], trail):
                    stack.append((trail, decided, tried, k))
                    break
                for a in trail:
                    del value[a]
                while tried:
                    if not stack:
                        return None
                    trail, decided, tried, k = stack.pop()
                    v = value[decided]
                    for a in trail:
                        del value[a]
                v, tried = not v, True


def solve(rows: list[tuple[list[tuple[str, str, bool]], list[tuple[str, str, bool]], int]], goal: Key) -> tuple[list[str], bool]:
    """Individuals that must satisfy the goal, and whether the clauses have a model."""
    number: dict[tuple[str, str], int] = {}

    def lit(pred: str, ind: str, pos: bool) -> int:
        a = number.setdefault((pred, ind), len(number) + 1)
        return a if pos else -a

    solver = Solver([([lit(*p) for p in lits], [lit(*p) for p in counted], bound) for lits, counted, bound in rows])
    first = solver.model([])
    if first is None:
        return [], False
    out = []
    open_ = {ind: a for (pred, ind), a in number.items() if pred == goal[0] and first.get(a) == goal[1]}
    while open_:
        ind, a = open_.popitem()
        other = solver.model([-a if goal[1] else a])
        if other is None:
            out.append(ind)
        else:
            open_ = {i: b for i, b in open_.items() if other.get(b) == goal[1]}
    return out, True


LITERAL = "struct<pred:string,ind:string,pos:boolean>"


def ground(rules: list[Rule], horn: Horn, goal: Key) -> DataFrame | None:
    """cid, lits, counted, bound: open ground clauses."""
    rows = []  # cid, bound, kind, pred, ind, pos
    base = horn.program.stated(rules)

    def only_facts(keys) -> list[Key]:
        """Literals that only a fact can contradict: where it isn't known, the clause is of no use."""
        return [k for k in keys if (k[0], not k[1]) not in base and k != goal]

    def known_false(df: DataFrame, column: str, keys) -> DataFrame:
        for k in only_facts(keys):
            df = df.join(horn.facts((k[0], not k[1])).withColumnRenamed("ind", column), column, "left_semi")
        return df

    def literal(cid, bound: int, kind: str, k: Key, ind):
        return F.struct(F.lit(bound).alias("bound"), F.lit(kind).alias("kind"), F.lit(k[0]).alias("pred"), ind.alias("ind"), F.lit(k[1]).alias("pos"))

    for i, r in enumerate(rules):
        if r.modal is None:
            cid = F.concat_ws("|", F.lit(str(i)), "ind")
            each = known_false(horn.individuals(), "ind", r.unary).select(cid.alias("cid"), F.explode(F.array(*[literal(cid, 0, "c", k, F.col("ind")) for k in r.unary])).alias("l"))
        else:
            n, role, filler = r.modal
            edges = horn.roles.edges(role, unique=True)
            if edges is None:
                continue
            edges = known_false(edges, "s", r.unary)
            if n == 0:
                cid = F.concat_ws("|", F.lit(str(i)), "s", "o")
                lits = [literal(cid, 0, "c", k, F.col("s")) for k in r.unary]
                if filler:
                    lits.append(literal(cid, 0, "c", (filler[0], not filler[1]), F.col("o")))
                    edges = known_false(edges, "o", [(filler[0], not filler[1])])
                if not lits:
                    continue
                each = edges.select(cid.alias("cid"), F.explode(F.array(*lits)).alias("l"))
            else:
                cid = F.concat_ws("|", F.lit(str(i)), "s")
                if not filler:
                    many = edges.groupBy("s").agg(F.count_distinct("o").alias("n")).where(F.col("n") > n)
                    if not r.unary:
                        continue
                    each = many.select(cid.alias("cid"), F.explode(F.array(*[literal(cid, 0, "c", k, F.col("s")) for k in r.unary])).alias("l"))
                else:
                    each = edges.select(cid.alias("cid"), literal(cid, n, "k", filler, F.col("o")).alias("l"))
                    if r.unary:
                        each = each.union(edges.select("s").distinct().select(cid.alias("cid"), F.explode(F.array(*[literal(cid, n, "c", k, F.col("s")) for k in r.unary])).alias("l")))
        rows.append(each.select("cid", "l.*"))
    if not rows:
        return None
    lits = rows[0]
    for r in rows[1:]:
        lits = lits.union(r)
    names = sorted({n for r in rules for n in r.names()})
    status = []
    for name in names:
        for pos in (True, False):
            f = horn.facts((name, pos))
            if f is not None:
                status.append(f.select(F.lit(name).alias("pred"), "ind", F.lit(pos).alias("value")))
    if status:
        known = status[0]
        for s in status[1:]:
            known = known.union(s)
        # contradictory individuals count as known true: their clauses are dropped
        known = known.groupBy("pred", "ind").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        lits = lits.join(known, ["pred", "ind"], "left")
        clash = F.col("low").isNotNull() & (F.col("low") != F.col("high"))
        true = F.coalesce(F.col("high") == F.col("pos"), F.lit(False)) | clash
        open_ = F.col("high").isNull()
    else:
        true, open_ = F.lit(False), F.lit(True)
    one = F.when(open_, F.struct("pred", "ind", "pos"))
    by = lits.groupBy("cid").agg(
        F.max((F.col("kind") == "c") & true).alias("done"),
        F.sum(F.when((F.col("kind") == "k") & true, 1).otherwise(0)).alias("true"),
        F.max("bound").alias("bound"),
        F.max(F.col("kind") == "k").alias("counts"),
        F.collect_set(F.when(F.col("kind") == "c", one)).alias("lits"),
        F.collect_set(F.when(F.col("kind") == "k", one)).alias("counted"),
    )
    left = F.col("bound") - F.col("true")
    useful = ~F.col("done") & F.when(F.col("counts"), (F.size("counted") > left) & (F.size("counted") > 0)).otherwise(F.size("lits") > 1)
    return by.where(useful).select("cid", "lits", "counted", F.when(F.col("counts"), left).otherwise(F.lit(0)).cast("int").alias("bound"))


def refute(goal: Key, rules: list[Rule], horn: Horn) -> tuple[DataFrame | None, DataFrame | None]:
    """Instances (ind) of the goal that only a contradiction proves, and the components (with one
    of their individuals) that are inconsistent."""
    clauses = ground(rules, horn, goal)
    if clauses is None:
        return None, None
    clauses = materialise(clauses, "ground")
    atom = lambda x: F.xxhash64(x["pred"], x["ind"])
    atoms = clauses.select("cid", F.transform(F.concat("lits", "counted"), atom).alias("atoms"))
    edges = atoms.select(F.col("atoms")[0].alias("u"), F.explode("atoms").alias("v"))
    parts = connected_components(edges, small=SMALL)
    placed = clauses.withColumn("node", atom(F.concat("lits", "counted")[0])).join(parts, "node", "left")
    placed = placed.select(F.coalesce("component", "node").alias("component"), "lits", "counted", "bound")
    goal_name, goal_pos = goal

    def check(table):
        triple = lambda p: (p["pred"], p["ind"], p["pos"])
        parts: dict[int, list] = {}
        for r in table.to_pylist():
            parts.setdefault(r["component"], []).append(([triple(p) for p in r["lits"]], [triple(p) for p in r["counted"]], r["bound"]))
        out: list[tuple[str, bool]] = []
        for rows in parts.values():
            if any(p[0] == goal_name for a, b, _ in rows for p in (*a, *b)):
                found, consistent = solve(rows, (goal_name, goal_pos))
                if not consistent:
                    found = [next(p[1] for a, b, _ in rows for p in (*a, *b))]
                out += [(i, consistent) for i in found]
        return pa.table({"ind": pa.array([i for i, _ in out], pa.string()), "consistent": pa.array([c for _, c in out], pa.bool_())})

    # many components are small: a call takes up all of a bucket
    buckets = 16 * int(clauses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    found = materialise(dealt.groupBy("bucket").applyInArrow(check, "ind string, consistent boolean"), "refuted")
    return found.where("consistent").select("ind"), found.where("not consistent").select("ind")
