"""Operators that prepare text and code for language-model training."""
