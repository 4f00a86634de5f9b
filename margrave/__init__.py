"""Spark-native private analytics and synthesis for tables spread over several data holders."""
