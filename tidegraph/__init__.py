"""Continuous queries over a labelled property graph, as Spark DataFrame plans."""
