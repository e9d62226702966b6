"""lexspark: Spark-native operators for annotated token corpora.

Every operator takes a DataFrame and returns one (usable with
``df.transform``); the work runs as Spark joins, aggregations, windows
and array expressions.  See ``lexspark.plans.queries`` for the named
queries checked against a SQL oracle.
"""

__version__ = "0.1.0"
