"""Operators that prepare training text, with their queries; nothing else in the library imports this."""
