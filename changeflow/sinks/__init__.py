"""Writers: replicated tables, monitoring tables, and the registry of target kinds."""
