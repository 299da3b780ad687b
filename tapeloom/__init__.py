"""tapeloom: a PySpark-native engine for FIX log analytics and training-data preparation."""
