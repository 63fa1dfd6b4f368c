"""Quality, energy accounting and forecast evaluation for multi-channel meter series, on Spark."""
