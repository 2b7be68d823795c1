"""attesta: evidence and citation recommendation as Spark DataFrame plans."""
