"""A Spark-native retrieval engine: files to chunks to vectors to neighbours."""
