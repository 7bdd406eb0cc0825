"""Concepts and workloads made from DataFrames."""
