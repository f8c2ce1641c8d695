"""quaymark: analytics over daily bars and text corpora, on Spark DataFrames."""
