"""Knowledge bases: tell axioms, bind names to data, ask.

Answers are what classical logic entails about named individuals, in an open world and under unique
names: sets without order or repetition, as DataFrames of strings.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridia.operators.horn import Horn, union
from veridia.operators.refute import refute
from veridia.operators.roles import Roles
from veridia.plans.program import Key, Program
from veridia.plans.terms import BOTTOM, TOP, Access, And, Axioms, Concept, DLError, InconsistentTBox, Not, Role, atom, inv, only, role
from veridia.sources.access import Reader, read_concept, read_role

log = logging.getLogger(__name__)
ASKED = "_asked"
SEED, REACHED = "_seed", "_reached"
#: Answers of a query whose variables nothing connects, at most.
MOST_PRODUCT = 10_000_000_000


def variable(x: str) -> bool:
    return x.startswith("?")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, name: str = "kb"):
        self.spark, self.name = spark, name
        self.connections: dict[str, Reader] = {}
        self._catalog: str | None = None
        self.clear()

    # ---- telling -----------------------------------------------------------------------------

    def clear(self) -> None:
        self.axioms = Axioms()
        self._concepts: dict[Key, list[DataFrame]] = {}
        self._roles: dict[str, list[DataFrame]] = {}
        self._forget()

    def snapshot(self, name: str | None = None) -> KnowledgeBase:
        """A copy that answers from what is told and bound now, whatever either of the two is told later."""
        out = KnowledgeBase(self.spark, name or self.name)
        out.connections, out._catalog = dict(self.connections), self._catalog
        out.axioms.merge(self.axioms)
        out._concepts = {k: list(v) for k, v in self._concepts.items()}
        out._roles = {k: list(v) for k, v in self._roles.items()}
        return out

    def _forget(self) -> None:
        self._programs: dict[Concept | None, Program] = {}
        self._told: tuple | None = None
        self._horns: dict[Concept | None, Horn] = {}
        self._refuted: dict[Concept, DataFrame | None] = {}
        self._asked: dict[str, dict[str, set[str]]] = {}

    def tell(self, axioms: Axioms) -> KnowledgeBase:
        """Adds axioms and facts to what was told before; everything is compiled together."""
        for a in axioms.accesses:
            self.bind(a)
        self.axioms.merge(axioms)
        self._forget()
        return self

    def concept(self, name: str, df: DataFrame, positive: bool = True) -> KnowledgeBase:
        """Individuals of a concept (or, with positive=False, known not to be): the first column of df."""
        self._concepts.setdefault((name, positive), []).append(df.select(F.col(df.columns[0]).cast("string").alias("ind")).where("ind is not null"))
        self._forget()
        return self

    def role(self, name: str, df: DataFrame) -> KnowledgeBase:
        """Pairs of a role: the first two columns of df."""
        s, o = df.columns[:2]
        self._roles.setdefault(name, []).append(df.select(F.col(s).cast("string").alias("s"), F.col(o).cast("string").alias("o")).where("s is not null and o is not null"))
        self._forget()
        return self

    def connect(self, name: str, reader: Reader) -> KnowledgeBase:
        """What accesses of the connection `name` read from, such as sources.access.jdbc_connection(url)."""
        self.connections[name] = reader
        return self

    def bind(self, access: Access) -> KnowledgeBase:
        """An external relation: a table or a SQL query of its connection. One connection that `connect` doesn't
        know is the session's own catalog; a second one is an error, since it would read the same tables."""
        reader = self.connections.get(access.connection) if access.connection else None
        if access.connection and reader is None:
            if self._catalog not in (None, access.connection):
                raise DLError(f"{access.name}: nothing is known of the connection {access.connection}", 301)
            self._catalog = access.connection
        if access.arity == 1:
            return self.concept(access.name, read_concept(self.spark, access, reader), access.positive)
        return self.role(access.name, read_role(self.spark, access, reader))

    def tell_file(self, path: str) -> KnowledgeBase:
        from veridia.sources import dig, tst

        return self.tell(dig.read_tells(path).axioms if path.endswith((".dig", ".xml")) else tst.read(path).axioms)

    # ---- what is stored ----------------------------------------------------------------------

    def _stored(self) -> tuple[dict[Key, DataFrame], dict[str, DataFrame]]:
        if self._told is None:
            concepts = {k: list(v) for k, v in self._concepts.items()}
            by_key: dict[Key, list[tuple[str]]] = {}
            for name, positive, i in self.axioms.concept_facts:
                by_key.setdefault((name, positive), []).append((i,))
            for k, rows in by_key.items():
                concepts.setdefault(k, []).append(self.spark.createDataFrame(rows, "ind string"))
            roles = {k: list(v) for k, v in self._roles.items()}
            by_role: dict[str, list[tuple[str, str]]] = {}
            for name, s, o in self.axioms.role_facts:
                by_role.setdefault(name, []).append((s, o))
            for k, rows in by_role.items():
                roles.setdefault(k, []).append(self.spark.createDataFrame(rows, "s string, o string"))
            self._told = {k: union(v) for k, v in concepts.items()}, {k: reduce(DataFrame.union, v) for k, v in roles.items()}
        return self._told

    def individuals(self) -> DataFrame:
        """All named individuals (ind)."""
        concepts, roles = self._stored()
        parts = [*concepts.values()]
        for r in roles.values():
            parts += [r.select(F.col("s").alias("ind")), r.select(F.col("o").alias("ind"))]
        if self.axioms.individuals:
            parts.append(self.spark.createDataFrame([(i,) for i in self.axioms.individuals], "ind string"))
        return union(parts) if parts else self.spark.createDataFrame([], "ind string")

    def program(self, asked: Concept | None = None) -> Program:
        if asked not in self._programs:
            p = Program(self.axioms, [(asked, atom(ASKED))] if asked is not None else [])
            p.check()
            if not p.complete:
                log.warning("saturation of %s stopped at its step bound: answers are right, but some may be missing", self.name)
            self._programs[asked] = p
        return self._programs[asked]

    def _horn(self, asked: Concept | None = None) -> Horn:
        if asked not in self._horns:
            program = self.program(asked)
            concepts, roles = self._stored()
            self._horns[asked] = Horn(program, concepts, Roles(roles, program.box), self.individuals)
        return self._horns[asked]

    def complete(self, asked: Concept | None = None) -> bool:
        """Whether saturation reached its end, so that no answer can be missing for want of steps."""
        return self.program(asked).complete

    # ---- asking ------------------------------------------------------------------------------

    def _goal(self, c: Concept) -> tuple[Key, Concept | None]:
        if c[0] == "atom":
            return (c[1], True), None
        if c[0] == "not" and c[1][0] == "atom":
            return (c[1][1], False), None
        return (ASKED, True), c

    def instances(self, c: Concept | str) -> DataFrame:
        """Individuals (ind) that provably belong to the concept."""
        c = atom(c) if isinstance(c, str) else c
        if c == TOP:
            return self.individuals()
        if c == BOTTOM:
            return self.individuals().limit(0)
        goal, asked = self._goal(c)
        horn = self._horn(asked)
        program = horn.program
        found = horn.facts(goal)
        rules = program.open_rules(goal, horn.possible, set(horn.roles.stored))
        if rules and not program.horn_for(goal, rules):
            if c not in self._refuted:
                self._refuted[c] = refute(goal, rules, horn)[0]
            more = self._refuted[c]
            if more is not None:
                found = more if found is None else found.union(more)
        return found.distinct() if found is not None else self.spark.createDataFrame([], "ind string")

    def instance(self, i: str, c: Concept | str) -> DataFrame:
        """One row: result (boolean)."""
        hit = self.instances(c).where(F.col("ind") == i).limit(1)
        return hit.agg((F.count("*") > 0).alias("result"))

    def related(self, r: Role | str) -> DataFrame:
        """Pairs (s, o) linked by the role, with hierarchy, inverses and transitivity."""
        r = role(r) if isinstance(r, str) else r
        found = self._horn().roles.whole(r)
        return found if found is not None else self.spark.createDataFrame([], "s string, o string")

    def fillers(self, i: str, r: Role | str) -> DataFrame:
        """Individuals (ind) that i is linked to by the role. Without transitive roles a filter, which reaches the sources."""
        r = role(r) if isinstance(r, str) else r
        box = self.program().box
        if not any(s in box.transitive for s in box.subs(r) | {r}):
            return self.related(r).where(F.col("s") == i).select(F.col("o").alias("ind")).distinct()
        return self.reached(self.spark.createDataFrame([(i,)], "ind string"), r)

    def reached(self, seeds: DataFrame, r: Role | str) -> DataFrame:
        """Individuals (ind) that some of seeds (ind) is linked to by the role. Of a transitive role only what the seeds
        reach is derived, by a recursion over individuals, and not all pairs."""
        r = role(r) if isinstance(r, str) else r
        self.program()  # an error if the axioms allow no individual, as for other questions
        program = Program(Axioms(roles=self.axioms.roles, transitive=self.axioms.transitive).implies(atom(SEED), only(r, atom(REACHED))))
        found = Horn(program, {(SEED, True): seeds}, Roles(self._stored()[1], program.box), self.individuals).facts((REACHED, True))
        return self.spark.createDataFrame([], "ind string") if found is None else found.distinct()

    def query(self, answer: Iterable[str], atoms: Iterable[tuple], exists: Iterable[tuple] = ()) -> DataFrame:
        """Conjunctive query. An atom is (concept, term) or (role, term, term); terms that start with
        "?" are variables, others individuals. exists: atoms that only have to hold for some values
        of their further variables. Columns are named by the answer variables, without "?"; without answer
        variables the result is one row, result (boolean). Atoms that share no variable with the answer, ground
        ones too, are tests; answer variables that nothing connects make a product (see `_product`)."""
        answer = list(dict.fromkeys(v[1:] for v in answer))
        own, inner = self._components(list(atoms)), self._components(list(exists))
        missing = [v for v in answer if not any(v in names for names, _ in own)]
        if missing:
            raise DLError(f"answer variables {missing} occur in no atom")
        linked = set(answer).union(*(names for names, _ in inner)) if inner else set(answer)
        frames, tests = [], []
        for names, parts in own:
            kept = sorted(names & linked)
            df = self._joined(parts)
            if names & set(answer) or kept:
                frames.append(df.select(*kept).distinct())
            else:
                tests.append(df)
        for names, parts in inner:
            df = self._joined(parts)
            meets = [k for k, f in enumerate(frames) if names & set(f.columns)]
            if not meets:
                tests.append(df)
                continue
            whole = frames[meets[0]]
            for k in meets[1:]:
                whole = self._product(whole, frames[k])
            shared = [c for c in whole.columns if c in names]
            frames = [f for k, f in enumerate(frames) if k not in meets] + [whole.join(df.select(*shared).distinct(), shared, "left_semi")]
        # a part without an answer variable only has to have a row
        tests += [f for f in frames if not set(f.columns) & set(answer)]
        frames = [f.select(*[c for c in f.columns if c in answer]).distinct() for f in frames if set(f.columns) & set(answer)]
        if not frames:
            out = self.spark.range(1).select(F.lit(True).alias("result"))
        else:
            out = frames[0]
            for f in frames[1:]:
                out = self._product(out, f)
        for test in tests:
            holds = test.limit(1).select(F.lit(1).alias("_holds"))  # one row at most
            out = out.withColumn("_holds", F.lit(1)).join(F.broadcast(holds), "_holds", "left_semi").drop("_holds")
        if not frames:
            return out.agg((F.count("*") > 0).alias("result"))
        return out.select(*answer)

    def _product(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """All pairs of rows, as answers that nothing connects ask for: both sides are counted, more than MOST_PRODUCT pairs
        are refused, and the pairs are dealt to keys by the larger side, with the smaller one at each key."""
        n, m = left.count(), right.count()
        if n * m > MOST_PRODUCT:
            raise DLError(f"the query has parts that share no variable, with {n} and {m} rows: more than {MOST_PRODUCT} answers")
        if n < m:
            left, right = right, left
        keys = max(1, min(1024, n * m // 1_000_000))
        dealt = left.withColumn("_key", F.pmod(F.xxhash64(*left.columns), F.lit(keys)))
        each = right.withColumn("_key", F.explode(F.sequence(F.lit(0), F.lit(keys - 1)).cast("array<bigint>")))
        return dealt.join(each, "_key").drop("_key")

    def _components(self, atoms: list[tuple]) -> list[tuple[set[str], list[DataFrame]]]:
        """Atoms as DataFrames, by the variables that connect them: (names, parts); a ground atom stands alone."""
        out: list[tuple[set[str], list[DataFrame]]] = []
        for what, *terms in atoms:
            if len(terms) == 2 and not variable(terms[0]):
                df = self.fillers(terms[0], what).select(F.lit(terms[0]).alias("s"), F.col("ind").alias("o"))
            elif len(terms) == 2 and not variable(terms[1]):
                df = self.fillers(terms[1], inv(what)).select(F.col("ind").alias("s"), F.lit(terms[1]).alias("o"))
            else:
                df = self.instances(what) if len(terms) == 1 else self.related(what)
            columns = df.columns
            for column, t in zip(columns, terms):
                if not variable(t):
                    df = df.where(F.col(column) == t)
            names = {c: t[1:] for c, t in zip(columns, terms) if variable(t)}
            if len(terms) == 2 and variable(terms[0]) and terms[0] == terms[1]:
                df, names = df.where(F.col("s") == F.col("o")), {"s": terms[0][1:]}
            part = df.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct() if names else df.limit(1).select(F.lit(1).alias("_holds"))
            met = [c for c in out if c[0] & set(names.values())]
            out = [c for c in out if c not in met] + [(set(names.values()).union(*(c[0] for c in met)), [p for c in met for p in c[1]] + [part])]
        return out

    @staticmethod
    def _joined(parts: list[DataFrame]) -> DataFrame:
        parts = list(parts)
        out = parts.pop(0)
        while parts:  # next an atom that shares a variable, so that no product is needed
            k = next(k for k, p in enumerate(parts) if set(p.columns) & set(out.columns))
            p = parts.pop(k)
            out = out.join(p, [c for c in p.columns if c in out.columns])
        return out

    def concept_names(self) -> list[str]:
        names = set(self.axioms.concept_names) | {k[0] for k in self._concepts} | {f[0] for f in self.axioms.concept_facts}
        for c, d in self.axioms.concepts:
            names |= _names(c) | _names(d)
        return sorted(n for n in names if not n.startswith("_"))

    def role_names(self) -> list[str]:
        out = set(self.axioms.role_names) | set(self._roles) | {f[0] for f in self.axioms.role_facts}
        out |= {r[0] for pair in self.axioms.roles for r in pair} | {r[0] for r in self.axioms.transitive}
        for c, d in self.axioms.concepts:
            out |= _role_names(c) | _role_names(d)
        return sorted(out)

    def types(self, i: str) -> DataFrame:
        """Names (concept) of the concepts that i provably belongs to."""
        parts = [self.instances(n).where(F.col("ind") == i).select(F.lit(n).alias("concept")) for n in self.concept_names()]
        return union(parts) if parts else self.spark.createDataFrame([], "concept string")

    def told_values(self, i: str, attribute: str) -> DataFrame:
        """Values (value) that were told of an individual: fillers of the role as stated, without anything derived."""
        told = self._stored()[1].get(attribute)
        return self.spark.createDataFrame([], "value string") if told is None else told.where(F.col("s") == i).select(F.col("o").alias("value")).distinct()

    def satisfiable(self, c: Concept | str) -> bool:
        c = atom(c) if isinstance(c, str) else c
        p = Program(self.axioms, [(atom(ASKED), c)])
        try:
            p.check()
        except InconsistentTBox:
            return False
        return not p.unsatisfiable(ASKED)

    def subsumes(self, c: Concept | str, d: Concept | str) -> bool:
        """Is every d a c?"""
        c, d = (atom(x) if isinstance(x, str) else x for x in (c, d))
        return not self.satisfiable(And(d, Not(c)))

    def disjoint(self, c: Concept | str, d: Concept | str) -> bool:
        c, d = (atom(x) if isinstance(x, str) else x for x in (c, d))
        return not self.satisfiable(And(c, d))

    def taxonomy(self) -> dict[str, set[str]]:
        """For each concept name the names that subsume it (itself left out)."""
        key = "taxonomy"
        if key not in self._asked:
            names = self.concept_names()
            program = self.program()  # saturated once: names are compared in the rules
            self._asked[key] = {d: {c for c in names if c != d and program.excludes((d, True), (c, False))} for d in names}
        return {d: set(up) for d, up in self._asked[key].items()}

    def ancestors(self, c: str) -> set[str]:
        return self.taxonomy()[c] - self.equivalents(c)

    def descendants(self, c: str) -> set[str]:
        t = self.taxonomy()
        return {d for d in t if c in t[d]} - self.equivalents(c)

    def equivalents(self, c: str) -> set[str]:
        t = self.taxonomy()
        return {d for d in t[c] if c in t[d]}

    def parents(self, c: str) -> set[str]:
        t, up = self.taxonomy(), self.ancestors(c)
        return {a for a in up if not any(a in t[b] and b not in t[a] for b in up)}

    def children(self, c: str) -> set[str]:
        t, down = self.taxonomy(), self.descendants(c)
        return {a for a in down if not any(b in t[a] and a not in t[b] for b in down)}

    def role_ancestors(self, r: Role | str) -> set[Role]:
        r = role(r) if isinstance(r, str) else r
        box = self.program().box
        return {s for s in box.supers(r) if r not in box.supers(s)}

    def role_descendants(self, r: Role | str) -> set[Role]:
        r = role(r) if isinstance(r, str) else r
        box = self.program().box
        return {s for s in box.subs(r) if r not in box.subs(s)}

    def role_parents(self, r: Role | str) -> set[Role]:
        up, box = self.role_ancestors(r), self.program().box
        return {a for a in up if not any(box.below(b, a) and not box.below(a, b) for b in up)}

    def role_children(self, r: Role | str) -> set[Role]:
        down, box = self.role_descendants(r), self.program().box
        return {a for a in down if not any(box.below(a, b) and not box.below(b, a) for b in down)}

    def inconsistencies(self) -> DataFrame:
        """(what, ind): individuals that derivation puts both inside and outside a concept, and those
        with more successors than a restriction allows (none, for what has none). Answers stay those derived; nothing
        follows from a contradiction."""
        horn = self._horn()
        parts = []
        for name in sorted({k[0] for k in horn.possible if (k[0], not k[1]) in horn.possible}):
            yes, no = horn.facts((name, True)), horn.facts((name, False))
            parts.append(yes.join(no, "ind", "left_semi").select(F.lit(name).alias("what"), "ind"))
        for r in horn.program.rules:
            # a rule that leaves nothing to derive at x: its body is a conflict
            if r.modal and not r.unary and (r.modal[2] is None or r.modal[2] in horn.possible) and horn.roles.edges(r.modal[1]) is not None:
                known = {r.modal[2]: horn.facts(r.modal[2])} if r.modal[2] else {}
                parts.append(horn.derive(r, ("", True), "x", known).select(F.lit(str(r)).alias("what"), "ind"))
        return union(parts) if parts else self.spark.createDataFrame([], "what string, ind string")

    def materialise(self, path: str, concepts: Iterable[str] | None = None, roles: Iterable[str] | None = None) -> None:
        """Writes what is entailed: path/concepts (pred, ind) and path/roles (pred, s, o), partitioned by
        pred, so that a reader of one predicate reads its files only. Default: all names."""
        wanted = self.concept_names() if concepts is None else list(concepts)
        for n in wanted:
            self.instances(n).write.mode("overwrite").parquet(f"{path}/concepts/pred={quote(n, safe='')}")
        for n in self.role_names() if roles is None else list(roles):
            self.related(n).write.mode("overwrite").parquet(f"{path}/roles/pred={quote(n, safe='')}")

    def ask_all(self, asks: Iterable[Callable[[KnowledgeBase], object]]) -> list[object]:
        """One answer for each ask; an ask that fails gives its error and doesn't stop the others."""
        out: list[object] = []
        for ask in asks:
            try:
                out.append(ask(self))
            except DLError as e:
                log.warning("ask failed: %s", e)
                out.append(e)
        return out

    def explain_rules(self, c: Concept | None = None) -> list[str]:
        return [str(r) for r in self.program(c).rules]

    @staticmethod
    def capabilities() -> dict[str, list[str]]:
        return {
            "language": ["top", "bottom", "catom", "and", "or", "not", "some", "all", "atleast", "atmost", "ratom", "feature", "inverse"],
            "tell": ["impliesc", "equalc", "disjoint", "impliesr", "equalr", "domain", "range", "transitive", "functional", "instanceof", "related", "defconcept", "defrole", "deffeature", "defindividual"],
            "ask": ["instances", "instance", "roleFillers", "relatedIndividuals", "allConceptNames", "allRoleNames", "allIndividuals", "satisfiable", "subsumes", "disjoint", "parents", "children", "ancestors", "descendants", "equivalents", "rparents", "rchildren", "rancestors", "rdescendants", "types"],
        }


def _names(c: Concept) -> set[str]:
    if c[0] == "atom":
        return {c[1]}
    return set().union(*(_names(x) for x in _parts(c)))


def _role_names(c: Concept) -> set[str]:
    own = {c[2][0]} if c[0] in ("min", "max") else set()
    return own.union(*(_role_names(x) for x in _parts(c)))


def _parts(c: Concept) -> list[Concept]:
    if c[0] == "not":
        return [c[1]]
    if c[0] in ("and", "or"):
        return list(c[1])
    return [c[3]] if c[0] in ("min", "max") else []
