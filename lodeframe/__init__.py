"""lodeframe: a Spark-native engine for coverage analytics over large text corpora."""
