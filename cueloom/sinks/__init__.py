"""What the engine writes."""
