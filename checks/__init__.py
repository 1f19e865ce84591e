"""The registered queries, the views they read, and their SQL twins for the oracle."""
