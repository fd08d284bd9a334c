"""Web-content analytics on Spark: recorded pages, feeds, sitemaps and probes in, typed tables out."""
