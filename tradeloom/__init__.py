"""Trade-journal analytics for all users at once, as Spark jobs."""
