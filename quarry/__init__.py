"""Web-search analytics as Spark plans."""
