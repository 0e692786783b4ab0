"""Change streams, event logs and derived views."""
