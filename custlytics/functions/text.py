"""Patterns for text."""

#: White space as the texts' own language has it, no-break and wide blanks included.
BLANK = r"(?U:[\s\x1C-\x1F])"
BLANK_IN_LINE = r"(?U:[\s\x1C-\x1F&&[^\n]])"
