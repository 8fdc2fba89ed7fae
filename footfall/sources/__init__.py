"""Table contracts, reading, writing, and the test-data adapter."""
