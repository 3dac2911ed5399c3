"""Evaluation sets over text and notation corpora, as Spark DataFrame operators."""
