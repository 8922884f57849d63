"""Analytics and corpus operators expressed as Spark DataFrame plans."""
