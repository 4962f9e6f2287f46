"""Column functions: text, numbers and Brazilian formats."""
