"""Training-corpus operators: thirteen whole-corpus jobs over DataFrames of documents."""
