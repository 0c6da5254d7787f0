"""Training-data operators: ten Spark jobs over documents, embeddings and pages.

Nothing else in the library imports this subpackage. Each module holds one
operator; :mod:`strata.llm.queries` holds the registered queries.
"""
