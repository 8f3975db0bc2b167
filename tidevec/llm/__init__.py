"""Operators for preparing language-model training data. Nothing else in tidevec imports this subpackage."""
