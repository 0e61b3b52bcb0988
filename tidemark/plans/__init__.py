"""Marts, dashboard queries, and the stages of a run."""
