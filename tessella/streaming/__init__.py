"""Event-by-event operators: batch forms over a log, and Structured Streaming forms over a stream."""
