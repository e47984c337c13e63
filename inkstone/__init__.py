"""inkstone: document-structure, compliance and ledger analytics on Spark DataFrames."""
