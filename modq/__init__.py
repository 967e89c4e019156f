"""modq: text moderation tables and streams on Spark."""
