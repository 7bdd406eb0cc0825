"""From axioms to rules: terms, normal form, saturation and the rule program. Driver side only."""
