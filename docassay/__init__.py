"""Evaluation of document extraction on Spark."""
