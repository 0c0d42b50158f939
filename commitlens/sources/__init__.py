"""Readers and writers of the formats in which histories, metrics and contributions come."""
