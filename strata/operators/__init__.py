"""DataFrame to DataFrame: history, views, gates, conformance, events, column checks."""
