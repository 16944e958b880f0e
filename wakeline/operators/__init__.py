"""Relational operators over keyed telemetry."""
