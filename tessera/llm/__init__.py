"""Operators that prepare text and vectors for language models; nothing else in the library imports this."""
