"""sentiloom: a Spark-native engine for social-post sentiment data.

Every public operator takes DataFrames and returns a DataFrame; nothing runs
until a sink (or a model fit) asks for it, except where a docstring says so.
"""
