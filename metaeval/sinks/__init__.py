"""Writers for predictions, result records and prepared tables."""
