"""Streaming forms of batch operators: an extension, batch results being the measure."""
