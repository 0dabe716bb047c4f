"""Spark-first document dataflow: cells, nodes, blocks, graphs, layouts, jobs."""
