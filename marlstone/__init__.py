"""marlstone: a Spark-first engine for code-and-text corpora."""
