"""The same checks over records that arrive as a stream."""
