"""Frame, point and pose operators: each takes and returns DataFrames."""
