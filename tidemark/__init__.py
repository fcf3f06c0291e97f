"""A Spark-native engine for change logs: from row events to current documents."""
