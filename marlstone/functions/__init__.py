"""See README.md for the operators in this subpackage."""
