"""Column expressions and rigid-body kernels."""
