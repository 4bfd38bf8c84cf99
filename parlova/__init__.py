"""Conversation analytics as lazy Spark DataFrame transformations."""
