"""Reviewer-recommendation analytics and corpus preparation on Spark."""
