"""A Spark-native engine for a compact SQL dialect over file, memory and Parquet tables."""
