"""Rule sets: facts to findings, policy, coverage, metrics."""
