"""linkloom subpackage."""
