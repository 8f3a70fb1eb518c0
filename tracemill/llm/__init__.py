"""Training-data operators.

Nothing else in the library imports this subpackage.  Each operator lives in
its own module with a general interface; :mod:`tracemill.llm.queries` derives
the registered ``opN_*`` queries from them.
"""
