"""DataFrame -> DataFrame steps of the valuation-control jobs."""
