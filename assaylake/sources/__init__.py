"""The sources of the library."""
