"""Spark-native analytics for annotated documents: layout matching, accuracy, workflow times, issues, texts."""
