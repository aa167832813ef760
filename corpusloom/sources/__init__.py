"""Readers, sinks and the relational views that the research queries run on."""
