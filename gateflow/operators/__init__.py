"""DataFrame -> DataFrame operators, to be composed with ``transform``."""
