"""Corpus analytics and training-data jobs as Spark DataFrame functions."""
