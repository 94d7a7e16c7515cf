"""quernlake: a relational, text-search, graph, change-feed and training-data engine built on Spark DataFrames."""
