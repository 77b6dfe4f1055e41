"""corpusq: a Spark-native analytics and grounded-retrieval engine for text corpora."""
