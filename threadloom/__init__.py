"""threadloom: Spark-first operators for paired discussion-thread datasets."""
