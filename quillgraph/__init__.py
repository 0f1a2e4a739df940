"""quillgraph: a PySpark-native knowledge-relation engine.

Corpora of notes become a scored one-hop document graph (mentions, explicit
links, vector similarity), explored through frozen, thresholded snapshots.
Every operator is a function from DataFrames to a DataFrame.
"""
