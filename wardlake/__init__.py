"""Security-scan analytics on Spark: code findings, risk, policy and runtime monitoring."""
