"""Operators on the text of training corpora. Nothing outside this folder imports it."""
