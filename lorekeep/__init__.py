"""lorekeep: analytics over append-only event logs, as Spark DataFrame plans."""
