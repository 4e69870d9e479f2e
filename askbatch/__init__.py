"""askbatch: batch web-corpus question answering on Spark DataFrames.

Questions, search responses, page snapshots, model requests/responses and
stored answers are tables; every operator is a DataFrame -> DataFrame
transformation built from Spark SQL built-ins.
"""

__version__ = "0.1.0"
