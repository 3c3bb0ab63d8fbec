"""Training-data operators: one module per operator, plus ``queries`` that registers them.

Nothing outside this subpackage imports it.  Every module works on DataFrames, keeps whole texts
and writes intermediate tables only below the folder named by ``spark.checkpoint.dir``.
"""
