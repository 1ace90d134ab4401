"""Structured Streaming over events: an extension of this engine, with the same operators as the batch plans where they allow it."""
