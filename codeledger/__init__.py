"""Classification-ledger analytics on Spark.

Assemble requests for a caller-supplied model function, read typed JSON out of its
answers, decide outcomes, reuse confirmed answers, apply reviews and report on the
resulting ledger: every operator is a DataFrame or Column transformation.
"""
