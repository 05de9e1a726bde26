"""prefspark: preference profiles and retrieval on Spark."""
