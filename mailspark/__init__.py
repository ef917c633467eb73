"""Spark jobs for large-scale e-mail threat analytics and corpus preparation."""
