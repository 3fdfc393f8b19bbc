"""Types, scalar codecs and predicates."""
