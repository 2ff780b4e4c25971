"""Factloom: a PySpark-native engine that turns documents into reconciled, auditable evidence."""
