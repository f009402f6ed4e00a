"""DataFrame operators, usable in batch and (where they keep no order) in streams."""
