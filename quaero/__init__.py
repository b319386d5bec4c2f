"""quaero: set-based analytics over question-and-answer notes, as Spark DataFrame jobs."""
