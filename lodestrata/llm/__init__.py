"""Operators for the texts of training corpora. Nothing outside this subpackage imports it."""
