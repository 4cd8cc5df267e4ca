"""Reading exports and bringing them to known names and types."""
