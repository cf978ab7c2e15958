"""Spark jobs for analysing source repositories, their history and their texts at scale."""
