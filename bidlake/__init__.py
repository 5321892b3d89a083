"""Procurement analytics on Spark: quotes, purchase history, matching, documents, email threads and evaluation."""
