"""Operators on text corpora: filtering, mixing, duplicates, tokens, search. Nothing else in the package imports them."""
