"""footfall: visitor-funnel analytics as batch Spark DataFrame jobs."""
