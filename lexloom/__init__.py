"""lexloom: a PySpark-native engine for document corpora, citation graphs and usage ledgers."""
