"""Registered queries, their SQL equivalents, and the jobs that chain the operators."""
