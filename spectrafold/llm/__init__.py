"""Operators for preparing training text, each by one named method; nothing else imports this."""
