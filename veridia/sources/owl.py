"""Facts of an OWL (RDF/XML) document as three tables: instances(subject, object, classname),
objectproperty(subject, object, objpropname), datatypeproperty(subject, value, dtpropname)."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

#: Fixed values.
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
SCHEMA_SPACES = ("http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#")


def local(uri: str) -> str:
    """The part of a name after its name space; names of different spaces can be equal in it."""
    return uri.rsplit("#", 1)[-1].rsplit("}", 1)[-1].rsplit("/", 1)[-1]


def whole(uri: str, base: str = "") -> str:
    """The whole name; a fragment or a relative name is one of the document's base."""
    if uri.startswith("{"):
        space, name = uri[1:].split("}", 1)
        return space + name
    if ":" in uri.split("#")[0].split("/")[0]:
        return uri
    return f"{base}{uri}" if uri.startswith("#") else f"{base}#{uri}"


def _schema(tag: str) -> bool:
    return tag[1:].split("}")[0] in SCHEMA_SPACES if tag.startswith("{") else False


def facts(path: str, short: bool = False):
    """(kind, a, b, name) of one document, streamed. short: names without their name space."""
    depth, name = 0, local
    for event, e in ET.iterparse(path, events=("start", "end")):
        if event == "start" and depth == 0 and not short:
            base = (e.get("{http://www.w3.org/XML/1998/namespace}base") or f"file:{path}").rstrip("#")
            name = lambda uri: whole(uri, base)
        depth += 1 if event == "start" else -1
        if event == "end" and depth == 1:
            yield from _individual(e, name)
            e.clear()


def _individual(e: ET.Element, named):
    subject = e.get(f"{RDF}about") or e.get(f"{RDF}ID")
    if subject is None or _schema(e.tag) and local(e.tag) != "Thing" and e.tag != f"{RDF}Description":
        return
    subject = named(subject)
    if not _schema(e.tag):
        yield "instance", subject, named(e.tag), named(e.tag)
    for p in e:
        if p.tag == f"{RDF}type":
            kind = p.get(f"{RDF}resource", "")
            if kind and local(kind) != "Thing":
                yield "instance", subject, named(kind), named(kind)
        elif _schema(p.tag):
            continue
        elif p.get(f"{RDF}resource") is not None:
            yield "object", subject, named(p.get(f"{RDF}resource")), named(p.tag)
        elif len(p):
            for inner in p:
                to = inner.get(f"{RDF}about") or inner.get(f"{RDF}ID")
                if to:
                    yield "object", subject, named(to), named(p.tag)
                    yield from _individual(inner, named)
        else:
            yield "data", subject, (p.text or "").strip(), named(p.tag)


def load(spark: SparkSession, *paths: str, short: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of the documents. Documents are read by tasks, one each, so their paths must
    be open to the executors. Names are whole, with their name spaces, unless short is set."""
    schema = "kind string, a string, b string, name string"

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(facts(path, short))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["kind", "a", "b", "name"])

    found = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(read, schema).distinct()
    pick = lambda kind, a, b, name: found.where(found["kind"] == kind).selectExpr(f"a as {a}", f"b as {b}", f"name as {name}")
    return pick("instance", "subject", "object", "classname"), pick("object", "subject", "object", "objpropname"), pick("data", "subject", "value", "dtpropname")
