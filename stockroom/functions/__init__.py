"""Column functions shared by the reports and jobs; all built-in expressions, no UDFs."""
