"""Trading-company analytics as lazy Spark DataFrame operators.

functions   column expressions
sources     table specs, readers, extracts, sinks
operators   DataFrame -> DataFrame building blocks
plans       the user-facing reports, composed from operators
streaming   incremental table synchronisation as a stream
cases       the registered queries with their SQL counterparts
"""
