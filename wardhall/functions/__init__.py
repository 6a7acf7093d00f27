"""Column expressions: masks, obfuscation, policy text."""
