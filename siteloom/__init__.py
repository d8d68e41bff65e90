"""Page-corpus audit analytics expressed as Spark DataFrame plans."""
