"""Extraction, graph, ranking and resolution operators: DataFrame in, DataFrame out."""
