"""Lexical document search and corpus analytics on PySpark."""
