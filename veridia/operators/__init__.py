"""Relational operators: role closure, forward derivation, proof by contradiction, components."""
