"""Training-data operators.

Nothing outside this package imports it; ``lumenframe.llm.registry`` lists the
queries and the SQL that ``__spark_entry__`` adds when the package is present.
"""
