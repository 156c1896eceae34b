"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it. ``sedimenta.llm.registry`` holds the
queries and the SQL that ``__spark_entry__`` adds when the subpackage is there.
"""
