"""Inkwell: visual symbol search over paged documents, on Spark."""
