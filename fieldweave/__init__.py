"""fieldweave: linear-encoding and corpus analytics expressed as Spark DataFrame plans."""
