"""Column expressions: text, prompts, prediction parsing, arrays, audio references."""
