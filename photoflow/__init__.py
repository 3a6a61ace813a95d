"""Analytics on irregularly sampled light curves, expressed as Spark plans."""
