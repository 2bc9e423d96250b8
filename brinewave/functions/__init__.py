"""Column expressions and the numeric kernels used inside tasks."""
