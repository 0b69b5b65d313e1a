"""Pairwise statistical models of fixed-width categorical data, on PySpark."""
