"""Tables and files the operators read from and write to."""
