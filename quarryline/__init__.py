"""quarryline: a Spark-native labour-market analytics engine.

Every operator is a ``DataFrame -> DataFrame`` function; Catalyst plans the physical work.
"""
