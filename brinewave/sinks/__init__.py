"""Writers and job control."""
