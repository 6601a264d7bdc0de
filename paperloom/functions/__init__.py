"""Column expressions: check digits, dates, text, transliteration."""
