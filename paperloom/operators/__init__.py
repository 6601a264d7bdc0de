"""DataFrame operators of document recognition."""
