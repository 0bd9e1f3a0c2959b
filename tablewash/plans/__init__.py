"""Lists of cleaning steps: stating, applying, suggesting and choosing them."""
