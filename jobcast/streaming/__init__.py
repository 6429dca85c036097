"""The window statistics and the scoring, as Structured Streaming jobs."""
