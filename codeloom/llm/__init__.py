"""Training-data operators: ten stages that clean, filter and mix a text corpus.

Each ``opN_*`` module holds one operator with a general interface and the thin
query that applies it to its whole table. :mod:`.registry` lists the queries.
Nothing outside this subpackage imports it.
"""
