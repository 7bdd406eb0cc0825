"""Extensions of roles: hierarchy, inverses and transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridia.plans.normal import RoleBox
from veridia.plans.terms import Role
from veridia.storage import materialise, remove

ROUNDS = 60


def swap(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), F.col("s").alias("o"))


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure by doubling: paths of length up to 2^k after k rounds; cycles end it too."""
    paths = materialise(edges.select("s", "o").distinct(), "paths")
    n = paths.count()
    for _ in range(ROUNDS):
        right = paths.select(F.col("s").alias("o"), F.col("o").alias("far"))
        longer = paths.join(right, "o").select("s", F.col("far").alias("o"))
        new = materialise(paths.union(longer).distinct(), "paths")
        m = new.count()
        remove(paths)
        paths = new
        if m == n:
            return paths
        n = m
    raise RuntimeError(f"paths did not settle in {ROUNDS} rounds")


class Roles:
    """stored: role name to a DataFrame (s, o)."""

    def __init__(self, stored: dict[str, DataFrame], box: RoleBox):
        self.stored, self.box = stored, box
        self._whole: dict[Role, DataFrame | None] = {}

    def edges(self, r: Role, unique: bool = False) -> DataFrame | None:
        """Of all roles below r, in r's direction, without transitivity (rules have that compiled in).
        Pairs may repeat unless unique: semi-joins and distinct counts don't mind, and a distinct on
        the pair would be a shuffle that no later join on one side can use."""
        parts = []
        for name, inverted in sorted(self.box.subs(r)):
            if name in self.stored:
                parts.append(swap(self.stored[name]) if inverted else self.stored[name])
        if not parts:
            return None
        out = parts[0].select("s", "o")
        for p in parts[1:]:
            out = out.union(p.select("s", "o"))
        return out.distinct() if unique else out

    def whole(self, r: Role) -> DataFrame | None:
        """All entailed pairs, with transitive roles at or below r closed."""
        if r not in self._whole:
            if r in self.box.transitive:
                own = self.edges(r)
                self._whole[r] = None if own is None else closure(own)
            else:
                parts = [self.edges(r)]
                parts += [self.whole(s) for s in sorted(self.box.subs(r)) if s != r and s in self.box.transitive]
                parts = [p for p in parts if p is not None]
                out = parts[0] if parts else None
                for p in parts[1:]:
                    out = out.union(p)
                self._whole[r] = None if out is None else out.distinct()
        return self._whole[r]
