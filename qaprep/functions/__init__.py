"""Column functions: no shuffle, no state, usable in batch and streaming."""
