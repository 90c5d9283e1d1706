"""Estimators: each one is a plan of aggregate jobs and projections."""
