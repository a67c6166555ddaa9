"""Portfolio analytics as Spark jobs: panels, exposures, regressions, risk, lots, rebalancing and filings."""
