"""foliomill: document conversion, cleaning, scoring and tracking as Spark jobs."""
