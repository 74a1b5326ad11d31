"""Batch operators: normalisation, usage/cost queries, quota, metrics, alarms, retention."""
