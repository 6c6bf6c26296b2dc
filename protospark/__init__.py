"""protospark: Spark jobs for spacer-to-target matching, hit validation and corpus preparation."""
