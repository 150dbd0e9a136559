"""Readers that turn files and tables into DataFrames."""
