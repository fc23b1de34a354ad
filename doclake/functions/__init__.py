"""Column functions. Native expressions throughout; ``exact`` holds the Arrow UDFs."""
