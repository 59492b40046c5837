"""Operators for training-data pipelines: joins, dedup, scoring, mixing and packing of text documents.

Every operator takes DataFrames and returns DataFrames. Work on text runs on Arrow batches inside Spark tasks;
everything that meets across documents goes through Spark's shuffles. Nothing outside this folder imports it.
"""
