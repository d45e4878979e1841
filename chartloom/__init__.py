"""Chartloom: personal-health-record analytics on PySpark."""
