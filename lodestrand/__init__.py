"""lodestrand: a Spark-native engine for document retrieval, its evaluation and corpus preparation."""
