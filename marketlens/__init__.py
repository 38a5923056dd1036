"""Market analytics as Spark jobs: prices, listings, attributes, search, valuation."""
