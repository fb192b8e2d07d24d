"""Labelled-text preparation, classification and evaluation on Spark DataFrames."""
