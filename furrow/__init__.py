"""Field-operations analytics on Spark: planning, routing, time ledgers and audits as DataFrame jobs."""
