"""Answers of knowledge bases: small cases of each operator, with the answers worked out by hand."""

import pytest

from veridia.kb import KnowledgeBase
from veridia.plans.terms import BOTTOM, TOP, Access, And, Axioms, DLError, InconsistentTBox, Not, Or, atleast, atmost, atom, inv, only, some
from veridia.sources import dig, tst


def names(df):
    return sorted(r[0] for r in df.collect())


def kb(spark, axioms):
    return KnowledgeBase(spark).tell(axioms)


def test_nested_existential(spark):
    told = Axioms().implies(some("made", And(some("holds", atom("Red")), some("holds", atom("Round")))), atom("Potter"))
    told.related("ann", "made", "bowl").related("bowl", "holds", "apple").fact(atom("Red"), "apple").fact(atom("Round"), "apple")
    told.related("ben", "made", "box").related("box", "holds", "brick").fact(atom("Red"), "brick")
    assert names(kb(spark, told).instances("Potter")) == ["ann"]


def test_universals_and_unnamed_successors(spark):
    """Whoever's juniors are all sworn is sworn; the founder's juniors' juniors are. Nobody need have any."""
    told = Axioms().implies(atom("Founder"), only("junior", only("junior", atom("Sworn")))).implies(only("junior", atom("Sworn")), atom("Sworn"))
    told.related("kim", "junior", "lou").related("max", "junior", "kim").fact(atom("Founder"), "kim")
    k = kb(spark, told)
    assert names(k.instances("Sworn")) == ["kim", "lou"]


def test_at_most_one_with_unique_names(spark):
    told = Axioms().implies(TOP, atmost(1, "seat", atom("Taken"))).fact(atom("Taken"), "s2")
    for s, o in (("row1", "s1"), ("row1", "s2"), ("row1", "s3"), ("row2", "s4"), ("row2", "s5")):
        told.related(s, "seat", o)
    k = kb(spark, told)
    assert names(k.instances(Not(atom("Taken")))) == ["s1", "s3"]
    assert names(k.inconsistencies().select("ind")) == []
    k.tell(Axioms().fact(atom("Taken"), "s4").fact(atom("Taken"), "s5"))
    assert names(k.inconsistencies().select("ind")) == ["row2"]


def test_at_least(spark):
    told = Axioms().implies(atleast(2, "r", atom("B")), atom("Many")).fact(atom("B"), "x").fact(atom("B"), "y")
    told.related("a", "r", "x").related("a", "r", "y").related("b", "r", "x").related("b", "r", "z")
    assert names(kb(spark, told).instances("Many")) == ["a"]


def test_transitive_role_below_another(spark):
    told = Axioms().subrole("child", "desc").subrole("desc", "rel").trans("desc").implies(some("rel", atom("G")), atom("H"))
    for i in range(6):
        told.related(f"i{i}", "child", f"i{i + 1}")
    told.fact(atom("G"), "i6").related("x", "rel", "i1")
    assert names(kb(spark, told).instances("H")) == [f"i{i}" for i in range(6)]


def test_inverse_facts_are_kept(spark):
    k = kb(spark, Axioms().related("e", inv("child"), "a").subrole("child", "desc"))
    assert [tuple(r) for r in k.related("desc").collect()] == [("a", "e")]
    assert names(k.fillers("e", inv("desc"))) == ["a"]


@pytest.mark.parametrize("n", [4, 9])
def test_case_split_along_a_chain(spark, n):
    told = Axioms().equal(atom("Good"), some("c", And(atom("P"), some("c", Not(atom("P"))))))
    for i in range(1, n):
        told.related("root", "c", f"i{i}").related(f"i{i}", "c", f"i{i + 1}")
    told.related("root", "c", f"i{n}").fact(atom("P"), "i1").fact(Not(atom("P")), f"i{n}")
    k = kb(spark, told)
    assert names(k.instances("Good")) == ["root"]
    assert k.instance("root", "Good").first()[0] and not k.instance("i1", "Good").first()[0]


def test_contradiction_of_an_assumption(spark):
    told = Axioms().implies(some("p", Not(atom("A"))), Not(atom("A"))).implies(some("f", atom("A")), Not(atom("A")))
    for i in range(5):
        told.related(f"i{i}", "p", f"i{i + 1}")
    told.related("i1", "f", "i4")
    k = kb(spark, told)
    assert names(k.instances(Not(atom("A")))) == ["i0", "i1"]
    assert names(k.instances("A")) == []


def test_open_world(spark):
    k = kb(spark, Axioms().fact(atom("A"), "x").fact(atom("B"), "y"))
    assert names(k.instances(Not(atom("A")))) == []
    assert names(k.instances(Or(atom("A"), Not(atom("A"))))) == ["x", "y"]


def test_disjunction_and_nested_cases(spark):
    told = Axioms().implies(atom("X"), Or(atom("L"), atom("M"), atom("N")))
    for c in "LMN":
        told.implies(atom(c), Or(atom("U"), atom("V")))
    told.implies(atom("U"), atom("Z")).implies(atom("V"), atom("Z")).fact(atom("X"), "a")
    assert names(kb(spark, told).instances("Z")) == ["a"]


def test_inconsistent_data_does_not_explode(spark):
    told = Axioms().disjoint(atom("A"), atom("B")).fact(atom("A"), "x").fact(atom("B"), "x").fact(atom("A"), "y")
    k = kb(spark, told)
    assert names(k.instances("A")) == ["x", "y"] and names(k.instances("B")) == ["x"]
    assert {tuple(r) for r in k.inconsistencies().collect()} == {("A", "x"), ("B", "x")}


def test_inconsistent_terminology(spark):
    with pytest.raises(InconsistentTBox):
        kb(spark, Axioms().implies(TOP, And(atom("A"), Not(atom("A")))).fact(atom("A"), "x")).instances("A")


def test_later_tells_add(spark):
    k = kb(spark, Axioms().implies(atom("A"), atom("B")).fact(atom("A"), "x"))
    assert names(k.instances("B")) == ["x"]
    k.tell(Axioms().implies(atom("B"), atom("C")))
    assert names(k.instances("C")) == ["x"]
    k.clear()
    assert names(k.instances("C")) == []


def test_conjunctive_queries(spark):
    told = Axioms().related("a", "r", "b").related("b", "r", "c").related("c", "r", "c").fact(atom("A"), "b")
    k = kb(spark, told)
    assert sorted(map(tuple, k.query(["?x", "?z"], [("r", "?x", "?y"), ("r", "?y", "?z"), ("A", "?y")]).collect())) == [("a", "c")]
    assert names(k.query(["?x"], [("r", "?x", "?x")])) == ["c"]
    assert names(k.query(["?y"], [("r", "a", "?y")])) == ["b"]
    assert names(k.query(["?x"], [("A", "?x"), ("A", "?y")])) == ["b"]  # the second atom is a test
    assert names(k.query(["?x"], [("r", "?x", "?y"), ("A", "a")])) == [] and names(k.query(["?x"], [("A", "b"), ("r", "?x", "b")])) == ["a"]
    assert sorted(map(tuple, k.query(["?x", "?y"], [("A", "?x"), ("r", "?y", "c")]).collect())) == [("b", "b"), ("b", "c")]
    assert names(k.query(["?x"], [("A", "?x")], exists=[("r", "?u", "?u")])) == ["b"]
    assert names(k.query(["?x"], [("A", "?x")], exists=[("r", "?u", "a")])) == []
    assert sorted(map(tuple, k.query(["?x", "?y"], [("r", "a", "?x"), ("r", "?y", "b")], exists=[("r", "?y", "?x")]).collect())) == [("b", "a")]
    assert k.query([], [("A", "b"), ("r", "a", "?y")]).first()["result"] and not k.query([], [("A", "c")]).first()["result"]
    with pytest.raises(DLError):
        k.query(["?z"], [("A", "?x")])


def test_rules_without_a_head_report_conflicts(spark):
    k = kb(spark, Axioms().implies(some("r"), BOTTOM).related("a", "r", "b"))
    assert {tuple(x) for x in k.inconsistencies().collect()} == {("at most 0 y: r(x, y)", "a")}


def test_connections(spark):
    spark.createDataFrame([("one",)], "n string").createOrReplaceTempView("conn_one")
    spark.createDataFrame([("two",)], "n string").createOrReplaceTempView("conn_two")
    k = KnowledgeBase(spark).connect("first", lambda s, table, query: s.table(f"{table}_one")).connect("second", lambda s, table, query: s.table(f"{table}_two"))
    k.bind(Access("A", 1, table=("conn", "n"), connection="first")).bind(Access("B", 1, table=("conn", "n"), connection="second"))
    assert names(k.instances("A")) == ["one"] and names(k.instances("B")) == ["two"]
    k.bind(Access("C", 1, table=("conn_one", "n"), connection="catalog"))
    with pytest.raises(DLError):
        k.bind(Access("D", 1, table=("conn_one", "n"), connection="unknown"))


def test_names_keep_their_spaces(tmp_path):
    from veridia.sources import owl

    (tmp_path / "o.owl").write_text(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xml:base="http://d.org/x" xmlns:a="http://a#" xmlns:b="http://b#">'
        '<a:P rdf:ID="i"><b:r rdf:resource="http://e.org/y#i"/></a:P><b:P rdf:about="#i"/></rdf:RDF>'
    )
    got = set(owl.facts(str(tmp_path / "o.owl")))
    i = "http://d.org/x#i"
    assert got == {("instance", i, "http://a#P", "http://a#P"), ("object", i, "http://e.org/y#i", "http://b#r"), ("instance", i, "http://b#P", "http://b#P")}


def test_names_and_taxonomy(spark):
    k = kb(spark, Axioms().implies(atom("Dog"), atom("Pet")).implies(atom("Pet"), atom("Animal")).equal(atom("Dog"), atom("Hound")).subrole("r", "s").subrole("s", "t").fact(atom("Dog"), "rex"))
    assert k.concept_names() == ["Animal", "Dog", "Hound", "Pet"] and k.role_names() == ["r", "s", "t"]
    assert k.parents("Dog") == {"Pet"} and k.ancestors("Dog") == {"Pet", "Animal"} and k.equivalents("Dog") == {"Hound"}
    assert k.children("Animal") == {"Pet"} and k.descendants("Animal") == {"Dog", "Hound", "Pet"}
    assert k.role_parents("r") == {("s", False)} and k.role_descendants("t") == {("r", False), ("s", False)}
    assert names(k.types("rex")) == ["Animal", "Dog", "Hound", "Pet"]
    assert k.subsumes("Animal", "Dog") and not k.subsumes("Dog", "Animal") and k.disjoint("Dog", Not(atom("Pet")))


TERMS = """
% a comment
query(instances(aconcept('Good')), [i1]).  query(instance(i1, aconcept('Good'))).
query(roleFillers(i1, arole(hasChild)), [i2, i3]). query(relatedIndividuals(arole(hasChild)), [i1-i2, i1-i3, i2-i3]).
equiv(and([some(arole(hasChild), and([aconcept('P'), some(arole(hasChild), not(aconcept('P')))]))]), aconcept('Good')).
rassertion(arole(hasChild), i1, i2). rassertion(inv(arole(hasChild)), i3, i1). rassertion(arole(hasChild), i2, i3).
dbConnection(db, source). dbAccess('P'/1, db, query('SELECT n FROM people WHERE p')).
dbAccess(not('P')/1, db, queries('SELECT n FROM people WHERE NOT p', 'SELECT 1 FROM people WHERE n = ? AND NOT p')).
options([indexing(yes)]).
"""


def test_term_file_with_sql_accesses(spark):
    spark.createDataFrame([("i2", True), ("i3", False), ("i1", None)], "n string, p boolean").createOrReplaceTempView("people")
    x = tst.parse(TERMS)
    k = kb(spark, x.axioms)
    for c in x.cases:
        if c.kind == "instances":
            assert set(names(k.instances(*c.args))) == c.expected
        elif c.kind == "instance":
            assert k.instance(*c.args).first()[0] == c.expected
        elif c.kind == "fillers":
            assert set(names(k.fillers(*c.args))) == c.expected
        else:
            assert {tuple(r) for r in k.related(*c.args).collect()} == c.expected
    again = tst.parse(tst.write(x.axioms))
    assert again.axioms.concepts == x.axioms.concepts and sorted(again.axioms.role_facts) == sorted(x.axioms.role_facts)


TELLS = """<?xml version="1.0"?><tells xmlns="http://dl.kr.org/dig/lang">
<defconcept name="A"/><deffeature name="f"/><impliesc><catom name="A"/><all><ratom name="r"/><catom name="B"/></all></impliesc>
<domain><ratom name="r"/><catom name="D"/></domain><equalr><ratom name="q"/><inverse><ratom name="r"/></inverse></equalr>
<instanceof><individual name="x"/><catom name="A"/></instanceof><related><individual name="x"/><ratom name="r"/><individual name="y"/></related>
<value><individual name="m:B"/><attribute name="m:hasQuery"/><sval>SELECT 'z'</sval></value>
<instanceof><individual name="m:B"/><catom name="B"/></instanceof></tells>"""
ASKS = """<asks xmlns="http://dl.kr.org/dig/2003/02/lang"><instances id="q1"><catom name="B"/></instances>
<instance id="q2"><individual name="x"/><catom name="D"/></instance><relatedIndividuals id="q3"><ratom name="q"/></relatedIndividuals>
<instances id="q4"><iset><individual name="x"/></iset></instances><nonsense id="q5"/></asks>"""


def test_xml_requests(spark):
    k = KnowledgeBase(spark)
    assert "<ok" in dig.execute(k, TELLS, database="m:")
    out = dig.execute(k, ASKS)
    assert out.index('id="q1"><individual name="y" /><individual name="z" />') and '<true id="q2"' in out
    assert '<individualPair><individual name="y" /><individual name="x" />' in out
    assert '<error id="q4" code="103"' in out and '<error id="q5" code="203"' in out
    assert 'code="101"' in dig.execute(k, "<oops")
    bad = TELLS.replace("<defconcept name=\"A\"/>", "<rangeint><attribute name=\"n\"/></rangeint>")
    assert 'code="301"' in dig.execute(k, bad, database="m:") and "warning" in dig.execute(k, bad, "drop", database="m:")
    assert "identifier" in dig.execute(k, '<getIdentifier xmlns="http://dl.kr.org/dig/lang"/>')
    assert dig.counters(TELLS)["instanceof"] == 2


def test_written_requests_and_facts(spark, tmp_path):
    told = Axioms().implies(And(atom("A"), some(inv("r"), atom("B"))), Or(Not(atom("C")), atmost(2, "r"))).subrole(inv("r"), "s").trans("s")
    told.fact(Not(atom("C")), "x").related("x", "r", "y").fact(TOP, "z").fact(atom("A"), "y")
    again = dig.parse(dig.write_tells(told)).axioms
    for k in ("concepts", "roles", "transitive", "concept_facts", "role_facts", "individuals"):
        assert getattr(again, k) == getattr(told, k)
    kb(spark, told).materialise(str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "m/concepts")).collect()} == {("y", "A")}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "m/roles")).collect()} == {("x", "y", "r"), ("y", "x", "s")}


def test_bulk_xml_and_owl(spark, tmp_path):
    path = tmp_path / "t.dig"
    path.write_text(TELLS)
    concepts, roles = dig.bulk_facts(spark, str(path))
    assert ("A", "x") in {tuple(r) for r in concepts.collect()} and [tuple(r) for r in roles.collect()] == [("r", "x", "y")]
    from veridia.sources import owl
    from veridia.sources.access import triple_store

    (tmp_path / "o.owl").write_text(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns="http://x.org/#">'
        '<owl:Class rdf:ID="C"/><C rdf:ID="a"><r rdf:resource="#b"/><age>7</age></C><owl:Thing rdf:about="#b"><rdf:type rdf:resource="#D"/></owl:Thing></rdf:RDF>'
    )
    inst, obj, data = owl.load(spark, str(tmp_path / "o.owl"), short=True)
    assert {tuple(r) for r in inst.collect()} == {("a", "C", "C"), ("b", "D", "D")}
    assert [tuple(r) for r in obj.collect()] == [("a", "b", "r")] and [tuple(r) for r in data.collect()] == [("a", "7", "age")]
    concept, role = triple_store(inst, obj)
    k = KnowledgeBase(spark).concept("D", concept("D")).role("r", role("r"))
    assert names(k.instances(some("r", atom("D")))) == ["a"]


def test_failing_asks_stand_alone(spark):
    k = kb(spark, Axioms().fact(atom("A"), "x"))
    first, second = k.ask_all([lambda k: k.query(["?z"], [("A", "?x")]), lambda k: names(k.instances("A"))])
    assert isinstance(first, DLError) and second == ["x"]


def test_stream_keeps_answers_up_to_date(spark, tmp_path):
    from veridia.streaming.follow import follow

    source = tmp_path / "in"
    spark.createDataFrame([("a", "b")], "s string, o string").write.parquet(str(source / "one"))
    schema = "s string, o string"

    def build(k, facts):
        k.role("r", facts).tell(Axioms().trans("r").implies(some("r", atom("T")), atom("T")).fact(atom("T"), "c"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source) + "/*")
        follow(stream, str(tmp_path / "facts"), str(tmp_path / "answers"), build, lambda k: k.instances("T"), str(tmp_path / "state")).awaitTermination()

    run()
    spark.createDataFrame([("b", "c")], schema).write.parquet(str(source / "two"))
    run()
    found = spark.read.parquet(str(tmp_path / "answers"))
    assert names(found.where("batch = 0").select("ind")) == ["c"] and names(found.where("batch = 1").select("ind")) == ["a", "b", "c"]


def test_fillers_follow_one_individual(spark):
    """From one end of transitive roles, below others and inverted, with cycles; the same as the pairs that start there."""
    told = Axioms().subrole("next", "after").trans("after").subrole("after", "linked").subrole(inv("back"), "after")
    for s, o in (("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")):
        told.related(s, "next", o)
    told.related("d", "back", "c").related("d", "linked", "x")
    k = kb(spark, told)
    for r in ("next", "after", "linked", inv("after"), inv("linked"), "back", "unknown"):
        pairs = [tuple(p) for p in k.related(r).collect()]
        for i in ("a", "c", "d", "x", "y", "nobody"):
            assert names(k.fillers(i, r)) == sorted(o for s, o in pairs if s == i)
    assert names(k.query(["?o"], [("after", "a", "?o")])) == ["a", "b", "c", "d"]
    assert names(k.query(["?s"], [("after", "?s", "d")])) == ["a", "b", "c"]
    assert [r.result for r in k.query([], [("after", "b", "d")]).collect()] == [True]
    assert [r.result for r in k.query([], [("after", "d", "b")]).collect()] == [False]
    assert names(k.reached(spark.createDataFrame([("x",), ("d",)], "ind string"), "linked")) == ["x", "y"]


def test_snapshots_stay_as_they_were(spark):
    k = kb(spark, Axioms().implies(atom("A"), atom("B")).fact(atom("A"), "x"))
    old = k.snapshot()
    k.tell(Axioms().implies(atom("C"), atom("B")).fact(atom("C"), "y"))
    k.concept("A", spark.createDataFrame([("z",)], "ind string"))
    assert names(k.instances("B")) == ["x", "y", "z"]
    assert names(old.instances("B")) == ["x"]
    old.tell(Axioms().fact(atom("A"), "w"))
    assert names(old.instances("B")) == ["w", "x"] and names(k.instances("B")) == ["x", "y", "z"]
