"""Deviance and drift analysis of hierarchical, yearly republished text corpora on Spark."""
