"""threadweave: Spark-first operators for question-and-answer corpora."""
