"""Package of the analytics engine."""
