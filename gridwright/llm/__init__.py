"""Operators on texts: packing, leaked evaluation passages, sentences. Nothing outside this subpackage imports it."""
