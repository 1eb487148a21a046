"""Set-similarity joins as Spark plans."""
