"""Writers for relabelled datasets."""
