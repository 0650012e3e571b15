"""Corpus, graph and ledger analytics on Spark DataFrames."""
