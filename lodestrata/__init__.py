"""Point-in-time evidence analytics expressed as Spark DataFrame plans."""
