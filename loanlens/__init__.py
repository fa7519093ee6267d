"""Loan-default risk analytics as Spark DataFrame operators."""
