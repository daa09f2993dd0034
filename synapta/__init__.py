"""Connectome analytics as Spark DataFrame operators."""
