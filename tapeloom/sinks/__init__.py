"""Stored tables that saves change, one partition or none at a time, and the jobs that keep them."""
