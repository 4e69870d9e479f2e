"""Training-data operators: dedup, quality, language, tokens, archives, mixing.

Nothing else in the library imports this subpackage; `catalog.py` holds its
registered queries and `corpus_pipeline.py` (repository top) chains five of
the operators.
"""
