"""Whole plans: builds of snapshots, and the queries over the test tables."""
