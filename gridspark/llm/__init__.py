"""Operators for preparing language-model training text.

Each module holds one operator with a general interface (DataFrame in,
DataFrame out); ``queries.py`` binds them to the ``documents``,
``conversations``, ``embeddings`` and ``labels`` tables.  Nothing else in the
library imports this subpackage.
"""
