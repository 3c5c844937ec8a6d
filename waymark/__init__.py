"""Landmark analytics over event tables, and operators of training-data pipelines, on PySpark DataFrames."""
