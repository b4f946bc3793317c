"""DataFrame to DataFrame operators the jobs are made of."""
