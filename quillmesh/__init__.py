"""A Spark-native engine for analysing large collections of documents and the URLs in them."""
