"""quern: a Spark-native engine for curating, checking and scoring datasets."""
