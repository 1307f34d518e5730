"""auditframe: DataFrame checks and measures over records of agents at work."""
