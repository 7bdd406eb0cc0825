"""XML requests and answers of the DIG protocol (1.0 and 1.1 name spaces)."""

from __future__ import annotations

import logging
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridia.plans.terms import (
    BOTTOM,
    TOP,
    Access,
    And,
    Axioms,
    Concept,
    DLError,
    Not,
    Or,
    Role,
    UnsupportedAsk,
    UnsupportedAxiom,
    UnsupportedConstruct,
    atleast,
    atmost,
    atom,
    inv,
    only,
    role,
    some,
)

from .access import retrieval, validate

log = logging.getLogger(__name__)

#: Name spaces of requests.
NAMESPACES = ("http://dl.kr.org/dig/lang", "http://dl.kr.org/dig/2003/02/lang")
UNSUPPORTED_CONCEPTS = {"iset", "defined", "stringmin", "stringmax", "stringequals", "stringrange", "intmin", "intmax", "intequals", "intrange"}
UNSUPPORTED_AXIOMS = {"rangeint", "rangestring", "defattribute", "value"}


@dataclass
class Request:
    kind: str  # newKB, clearKB, releaseKB, getIdentifier, tells, asks
    uri: str | None = None
    axioms: Axioms = field(default_factory=Axioms)
    asks: list[tuple[str, str, tuple]] = field(default_factory=list)  # id, kind, arguments
    clears: bool = False
    skipped: list[str] = field(default_factory=list)


def _tag(e: ET.Element) -> str:
    space, _, name = e.tag.rpartition("}")
    if space and space[1:] not in NAMESPACES:
        raise DLError(f"unknown name space {space[1:]}", 101)
    return name


def read_role(e: ET.Element) -> Role:
    kind = _tag(e)
    if kind in ("ratom", "feature"):
        return role(e.get("name"))
    if kind == "inverse":
        return inv(read_role(e[0]))
    raise UnsupportedConstruct(f"{kind} can't be used as a role")


def read_concept(e: ET.Element) -> Concept:
    kind, parts = _tag(e), list(e)
    if kind in ("top", "bottom"):
        return TOP if kind == "top" else BOTTOM
    if kind == "catom":
        return atom(e.get("name"))
    if kind == "not":
        return Not(read_concept(parts[0]))
    if kind in ("and", "or"):
        return (And if kind == "and" else Or)(*map(read_concept, parts))
    if kind in ("some", "all"):
        return (some if kind == "some" else only)(read_role(parts[0]), read_concept(parts[1]))
    if kind in ("atleast", "atmost"):
        return (atleast if kind == "atleast" else atmost)(int(e.get("num")), read_role(parts[0]), read_concept(parts[1]) if len(parts) > 1 else TOP)
    if kind in UNSUPPORTED_CONCEPTS:
        raise UnsupportedConstruct(f"{kind} isn't supported")
    raise DLError(f"unknown concept {kind}", 102)


class _Tells:
    """database: the prefix of the names (has...Query, hasConnection, ...) that bind the ontology to a database."""

    def __init__(self, request: Request, database: str | None):
        self.r, self.prefix = request, database
        self.db: dict[str, dict[str, str]] = {}
        self.of: dict[str, tuple[str, int]] = {}
        self.connection: dict[str, str] = {}

    def axiom(self, e: ET.Element) -> None:
        kind, parts, ax = _tag(e), list(e), self.r.axioms
        if self._database(kind, e, parts):
            return
        if kind == "defconcept":
            ax.concept_names.append(e.get("name"))
        elif kind in ("defrole", "deffeature"):
            ax.role_names.append(e.get("name"))
            if kind == "deffeature":
                ax.functional(e.get("name"))
        elif kind == "defindividual":
            pass
        elif kind == "impliesc":
            ax.implies(read_concept(parts[0]), read_concept(parts[1]))
        elif kind == "equalc":
            ax.equal(read_concept(parts[0]), read_concept(parts[1]))
        elif kind == "disjoint":
            ax.disjoint(*map(read_concept, parts))
        elif kind == "impliesr":
            ax.subrole(read_role(parts[0]), read_role(parts[1]))
        elif kind == "equalr":
            ax.equal_roles(read_role(parts[0]), read_role(parts[1]))
        elif kind == "domain":
            ax.domain(read_role(parts[0]), read_concept(parts[1]))
        elif kind == "range":
            ax.range(read_role(parts[0]), read_concept(parts[1]))
        elif kind == "transitive":
            ax.trans(read_role(parts[0]))
        elif kind == "functional":
            ax.functional(read_role(parts[0]))
        elif kind == "instanceof":
            ax.fact(read_concept(parts[1]), parts[0].get("name"))
        elif kind == "related":
            ax.related(parts[0].get("name"), read_role(parts[1]), parts[2].get("name"))
        elif kind in ("differentfrom", "alldifferent"):
            pass  # names are unique
        elif kind == "clearKB":
            self.r.clears = True
            self.r.axioms = Axioms()
        elif kind in UNSUPPORTED_AXIOMS:
            raise UnsupportedAxiom(f"{kind} isn't supported")
        else:
            raise DLError(f"unknown axiom {kind}", 302)

    def _database(self, kind: str, e: ET.Element, parts: list[ET.Element]) -> bool:
        """Takes up what the database vocabulary says."""
        if not self.prefix:
            return False
        names = [x.get("name", "") for x in parts]
        if kind in ("defattribute", "defrole", "defindividual", "rangestring", "functional"):
            return (e.get("name") or (names[0] if names else "")).startswith(self.prefix)
        if not names or not names[0].startswith(self.prefix):
            return False
        if kind == "value":
            self.db.setdefault(names[0], {})[names[1].removeprefix(self.prefix)] = (parts[2].text or "").strip()
        elif kind == "instanceof":
            if _tag(parts[1]) == "catom":
                self.of[names[0]] = (parts[1].get("name"), 1)
        elif kind == "related":
            if names[1] == f"{self.prefix}hasConnection":
                self.connection[names[0]] = names[2].removeprefix(self.prefix)
            else:
                self.of[names[0]] = (names[1], 2)
        else:
            return False
        return True

    def accesses(self) -> list[Access]:
        out = []
        for bound, (name, arity) in self.of.items():
            have = self.db.get(bound, {})
            for sign, positive in (("", True), ("Neg", False)):
                queries = [have[k] for k in sorted(have) if k.startswith(f"has{sign}") and "Query" in k and (positive != k.startswith("hasNeg"))]
                table, columns = have.get(f"has{sign}Table"), [have[k] for k in (f"has{sign}Column", f"has{sign}LeftColumn", f"has{sign}RightColumn") if k in have]
                if not (queries or table):
                    continue
                try:
                    if table:
                        access = Access(name, arity, positive, table=(table, *columns), connection=self.connection.get(bound))
                    else:
                        access = Access(name, arity, positive, query=retrieval(*queries), connection=self.connection.get(bound))
                    out.append(validate(access))
                except DLError as error:
                    log.warning("access dropped: %s", error)
        return out


def _ask(e: ET.Element) -> tuple[str, str, tuple]:
    kind, parts = _tag(e), list(e)
    concept = lambda k: read_concept(parts[k])
    if kind in ("allConceptNames", "allRoleNames", "allIndividuals"):
        args: tuple = ()
    elif kind in ("instances", "satisfiable", "parents", "children", "ancestors", "descendants", "equivalents"):
        args = (concept(0),)
    elif kind in ("subsumes", "disjoint"):
        args = (concept(0), concept(1))
    elif kind in ("rparents", "rchildren", "rancestors", "rdescendants", "relatedIndividuals"):
        args = (read_role(parts[0]),)
    elif kind == "instance":
        args = (parts[0].get("name"), concept(1))
    elif kind == "roleFillers":
        args = (parts[0].get("name"), read_role(parts[1]))
    elif kind == "types":
        args = (parts[0].get("name"),)
    else:
        raise UnsupportedAsk(f"{kind} isn't supported")
    return e.get("id", ""), kind, args


def parse(text: str | bytes, on_unsupported: str = "raise", database: str | None = None) -> Request:
    """on_unsupported: "raise" or "drop" (the axiom is skipped and listed). database: the name prefix of the database vocabulary."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as error:
        raise DLError(f"not well-formed: {error}", 101) from error
    kind = _tag(root)
    if kind not in ("newKB", "clearKB", "releaseKB", "getIdentifier", "tells", "asks"):
        raise DLError(f"unknown request {kind}", 101)
    out = Request(kind, root.get("uri"))
    if kind == "tells":
        tells = _Tells(out, database)
        for e in root:
            try:
                tells.axiom(e)
            except (UnsupportedConstruct, UnsupportedAxiom) as error:
                if on_unsupported == "raise":
                    raise
                out.skipped.append(str(error))
        out.axioms.accesses += tells.accesses()
    elif kind == "asks":
        for e in root:
            try:
                out.asks.append(_ask(e))
            except DLError as error:
                out.asks.append((e.get("id", ""), "error", (error,)))
    return out


def read_tells(path: str, on_unsupported: str = "raise", database: str | None = None) -> Request:
    with open(path, "rb") as f:
        return parse(f.read(), on_unsupported, database)


def counters(text: str | bytes) -> dict[str, int]:
    """How often each kind of axiom occurs."""
    out: dict[str, int] = {}
    for e in ET.fromstring(text):
        out[_tag(e)] = out.get(_tag(e), 0) + 1
    return out


def bulk_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concept facts (pred, ind) and role facts (pred, s, o) of a large request, read by Spark's own
    XML source; only atomic concepts and roles."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    concepts = read("instanceof", "individual struct<_name:string>, catom struct<_name:string>").select(F.col("catom._name").alias("pred"), F.col("individual._name").alias("ind"))
    roles = read("related", "individual array<struct<_name:string>>, ratom struct<_name:string>")
    roles = roles.select(F.col("ratom._name").alias("pred"), F.col("individual")[0]["_name"].alias("s"), F.col("individual")[1]["_name"].alias("o"))
    return concepts.where("pred is not null"), roles.where("pred is not null")


def _role_element(r: Role) -> ET.Element:
    own = ET.Element("ratom", {"name": r[0]})
    if not r[1]:
        return own
    out = ET.Element("inverse")
    out.append(own)
    return out


def _concept_element(c: Concept) -> ET.Element:
    kind = c[0]
    if kind == "atom":
        return ET.Element("catom", {"name": c[1]})
    if kind in ("top", "bottom"):
        return ET.Element(kind)
    if kind in ("not", "and", "or"):
        out = ET.Element(kind)
        for x in [c[1]] if kind == "not" else c[1]:
            out.append(_concept_element(x))
        return out
    out = ET.Element("atleast" if kind == "min" else "atmost", {"num": str(c[1])})
    out.append(_role_element(c[2]))
    out.append(_concept_element(c[3]))
    return out


def write_tells(axioms: Axioms) -> str:
    """The axioms as a tells request."""
    root = ET.Element("tells", {"xmlns": NAMESPACES[0]})

    def add(kind: str, *parts: ET.Element, **attributes: str) -> None:
        e = ET.SubElement(root, kind, attributes)
        e.extend(parts)

    person = lambda i: ET.Element("individual", {"name": i})
    for n in axioms.concept_names:
        add("defconcept", name=n)
    for n in axioms.role_names:
        add("defrole", name=n)
    for c, d in axioms.concepts:
        add("impliesc", _concept_element(c), _concept_element(d))
    for r, s in axioms.roles:
        add("impliesr", _role_element(r), _role_element(s))
    for r in axioms.transitive:
        add("transitive", _role_element(r))
    for n, positive, i in axioms.concept_facts:
        add("instanceof", person(i), _concept_element(("atom", n) if positive else ("not", ("atom", n))))
    for i in axioms.individuals:
        add("instanceof", person(i), ET.Element("top"))
    for n, s, o in axioms.role_facts:
        add("related", person(s), _role_element(role(n)), person(o))
    return ET.tostring(root, encoding="unicode")


# ---- answers -----------------------------------------------------------------------------------


def answer(kb, ident: str, kind: str, args: tuple) -> ET.Element:
    """The answer element of one ask; errors become error elements."""
    try:
        if kind == "error":
            raise args[0]
        return _answer(kb, ident, kind, args)
    except DLError as error:
        return ET.Element("error", {"id": ident, "code": str(error.code), "message": str(error)})


def _answer(kb, ident: str, kind: str, args: tuple) -> ET.Element:
    def names(tag: str, inner: str, found) -> ET.Element:
        out = ET.Element(tag, {"id": ident})
        for n in sorted(found):
            group = out if tag == "individualSet" else ET.SubElement(out, "synonyms")
            ET.SubElement(group, inner, {"name": n})
        return out

    def truth(v: bool) -> ET.Element:
        return ET.Element("true" if v else "false", {"id": ident})

    def named(c: Concept) -> str:
        if c[0] != "atom":
            raise UnsupportedAsk(f"{kind} is answered for concept names")
        return c[1]

    if kind == "instances":
        return names("individualSet", "individual", (r[0] for r in kb.instances(*args).toLocalIterator()))
    if kind == "instance":
        return truth(kb.instance(*args).first()[0])
    if kind == "roleFillers":
        return names("individualSet", "individual", (r[0] for r in kb.fillers(*args).toLocalIterator()))
    if kind == "relatedIndividuals":
        out = ET.Element("individualPairSet", {"id": ident})
        for s, o in sorted(tuple(r) for r in kb.related(*args).toLocalIterator()):
            pair = ET.SubElement(out, "individualPair")
            ET.SubElement(pair, "individual", {"name": s})
            ET.SubElement(pair, "individual", {"name": o})
        return out
    if kind == "allIndividuals":
        return names("individualSet", "individual", (r[0] for r in kb.individuals().toLocalIterator()))
    if kind == "allConceptNames":
        return names("conceptSet", "catom", kb.concept_names())
    if kind == "allRoleNames":
        return names("roleSet", "ratom", kb.role_names())
    if kind in ("satisfiable", "subsumes", "disjoint"):
        return truth(getattr(kb, kind)(*args))
    if kind in ("parents", "children", "ancestors", "descendants", "equivalents"):
        return names("conceptSet", "catom", getattr(kb, kind)(named(args[0])))
    if kind == "types":
        return names("conceptSet", "catom", (r[0] for r in kb.types(*args).collect()))
    method = {"rparents": "role_parents", "rchildren": "role_children", "rancestors": "role_ancestors", "rdescendants": "role_descendants"}[kind]
    return names("roleSet", "ratom", (n for n, inverted in getattr(kb, method)(*args) if not inverted))


def execute(kb, text: str | bytes, on_unsupported: str = "raise", database: str | None = None) -> str:
    """Runs one request on a knowledge base and gives the answer document."""
    try:
        r = parse(text, on_unsupported, database)
        if r.kind == "asks":
            out = ET.Element("responses")
            for ident, kind, args in r.asks:
                out.append(answer(kb, ident, kind, args))
            return ET.tostring(out, encoding="unicode")
        if r.kind == "getIdentifier":
            out = ET.Element("identifier", {"name": "veridia"})
            for group, items in kb.capabilities().items():
                part = ET.SubElement(ET.SubElement(out, "supports"), group)
                for i in items:
                    ET.SubElement(part, i)
            return ET.tostring(out, encoding="unicode")
        if r.kind in ("clearKB", "releaseKB") or r.clears:
            kb.clear()
        if r.kind == "tells":
            kb.tell(r.axioms)
        out = ET.Element("response")
        ET.SubElement(out, "ok")
        for s in r.skipped:
            ET.SubElement(out[0], "warning", {"code": "301", "message": s})
        return ET.tostring(out, encoding="unicode")
    except DLError as error:
        out = ET.Element("response")
        ET.SubElement(out, "error", {"code": str(error.code), "message": str(error)})
        return ET.tostring(out, encoding="unicode")
