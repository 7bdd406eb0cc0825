"""Ontology-mediated queries on Spark."""
