"""folioframe: mail, ledger, retrieval and text analytics as Spark DataFrames."""
