"""Named feature sets."""
