"""DataFrame operators of the listing pipeline."""
