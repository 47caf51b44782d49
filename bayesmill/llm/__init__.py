"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator is a module with a
general interface; :mod:`bayesmill.llm.queries` binds each of them to the
driver's tables.
"""
