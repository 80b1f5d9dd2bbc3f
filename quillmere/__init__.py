"""quillmere: Spark-native knowledge retrieval, evidence analytics and corpus preparation."""
