"""Streams: counters, samples, sessions, settled files, seen items and seeding clocks."""
