"""State-space analytics of neural-network layers on Spark."""
