"""Whole stages: the only place besides the sinks where Spark jobs are started."""
