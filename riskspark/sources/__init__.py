"""Table readers and writers, and the adapter from the shared star schema."""
