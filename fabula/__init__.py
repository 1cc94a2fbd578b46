"""Narrative corpus analytics as Spark DataFrame operators."""
