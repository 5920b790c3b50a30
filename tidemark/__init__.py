"""Tidemark: analytical table operators expressed as Spark DataFrame plans.

Every operator takes a DataFrame plus parameters and returns a DataFrame.
"""
