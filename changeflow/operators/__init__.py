"""Operators over the change log and the monitoring tables; each takes and gives DataFrames."""
