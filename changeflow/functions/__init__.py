"""Column functions: names, time ranges, display labels."""
