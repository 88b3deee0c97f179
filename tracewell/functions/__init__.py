"""Part of tracewell; see README.md."""
