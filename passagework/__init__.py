"""Sentence and paragraph boundaries over document tables, as Spark plans."""
