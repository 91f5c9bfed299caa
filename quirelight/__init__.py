"""quirelight: Spark-first analytics over collections of short scholarly texts."""
