"""Knowledge-corpus graphs, ledgers, change streams, telemetry and audits on Spark."""
