"""Tessera: retrieval, ranking and corpus analytics expressed as Spark plans."""
