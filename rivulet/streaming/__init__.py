"""Element-wise pipelines over Structured Streaming sources."""
