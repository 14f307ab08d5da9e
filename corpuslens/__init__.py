"""A Spark-native analytics engine for dated, tagged text corpora."""
