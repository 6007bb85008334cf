"""Column expressions: verdicts, bands, text measures, report formats."""
