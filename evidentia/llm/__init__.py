"""Training-data operators: one module per operator, queries in ``evidentia.llm.catalog``.

Nothing outside this subpackage imports it.
"""
