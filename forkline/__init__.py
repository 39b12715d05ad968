"""forkline: branching-narrative and event-graph analytics as Spark DataFrame plans."""
