"""Sequencing-record analytics on Spark DataFrames."""
