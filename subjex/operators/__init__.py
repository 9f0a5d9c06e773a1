"""DataFrame -> DataFrame operators of the subject-indexing workload."""
