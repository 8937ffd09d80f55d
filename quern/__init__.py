"""quern: text, retrieval, evaluation and telemetry analytics on Spark DataFrames."""
