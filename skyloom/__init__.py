"""Skyloom: sky images as pixel tables, source catalogs as record tables, on Spark DataFrames."""
