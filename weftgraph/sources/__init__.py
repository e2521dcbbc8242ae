"""Reading documents and registry tables."""
