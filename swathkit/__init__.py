"""A catalogue of Earth-observation products and its searches by time, region and in-situ points, as Spark plans."""
