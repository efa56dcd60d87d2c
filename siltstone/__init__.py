"""Siltstone: snapshot, graph and corpus analytics as plain PySpark DataFrame operators."""
