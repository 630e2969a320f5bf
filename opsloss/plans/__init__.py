"""Model graph, registered queries with their SQL oracles, and scheduled jobs."""
