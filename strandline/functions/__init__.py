"""Part of the message-archive engine."""
