"""folium: a Spark-native engine for document layout data and training-data preparation."""

__version__ = "0.1.0"
