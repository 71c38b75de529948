"""Types of models and of Spark."""
