"""Readers and writers: term files, XML requests and answers, ontology data, external relations."""
