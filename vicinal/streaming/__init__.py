"""There are no streaming operators: every input is a bounded table."""
