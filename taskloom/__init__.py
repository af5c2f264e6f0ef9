"""Spark-first analytics over background-task, workflow and event data."""
