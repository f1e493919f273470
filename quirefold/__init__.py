"""quirefold: document-layout inference analytics on PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function; see ``README.md``.
"""
