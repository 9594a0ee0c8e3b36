"""Other ways to find joinable columns and to augment, for comparison."""
