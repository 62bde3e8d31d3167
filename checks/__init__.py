"""Independent SQL for the catalogue's results; not used by the engine."""
