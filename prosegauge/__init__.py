"""Prose analytics over document corpora, expressed as Spark DataFrames."""
