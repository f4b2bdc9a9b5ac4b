"""Find, track and audit sensitive text in ordered sequences of screen content, on Spark."""
