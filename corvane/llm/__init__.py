"""Operators for corpora of a language model; nothing outside this subpackage imports it."""
