"""Spark-native analytics over collections of spreadsheet workbooks."""
