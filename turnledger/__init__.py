"""Conversation token and cost analytics on Spark."""
