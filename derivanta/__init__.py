"""Derivation analytics on Spark: scoring, algebra, expressions and reports over DataFrames."""
