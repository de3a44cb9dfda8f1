"""Log triage and classifier evaluation as Spark jobs."""
