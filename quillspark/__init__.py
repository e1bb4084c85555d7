"""A PySpark-native knowledge catalog: Markdown documents as relational, graph and inverted-index DataFrames."""
