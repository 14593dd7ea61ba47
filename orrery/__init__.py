"""A strictly typed, versioned relational engine on Spark."""
