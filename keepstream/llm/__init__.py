"""Operators for large text and training-data work; nothing else imports this package."""
