"""Writers and formatters."""
