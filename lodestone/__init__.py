"""Spark jobs for context retrieval over large document collections."""
