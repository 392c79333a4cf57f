"""Account-risk triage as Spark jobs: clean, split, train, score, explain, review."""
