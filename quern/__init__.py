"""Document retrieval, evaluation and training-data operators as Spark DataFrame transformations."""
