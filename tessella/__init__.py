"""A Spark-native engine for preparing multimodal training corpora."""
