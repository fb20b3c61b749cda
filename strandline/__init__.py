"""A PySpark engine for time-stamped, speaker-labelled text streams."""
