"""Frozen constants of the domain."""

#: Sampling of a window, the tracking policy, the persistence rule and the bootstrap.
SAMPLE_RATE, WINDOW_SAMPLES = 8000, 8000
OPEN_AT, OPEN_RUN = 0.8, 3
CLOSE_AT, CLOSE_RUN = 0.4, 5
PERSIST_OVER = 30
HISTORY = 64
DRAWS = 2000
SILENT_STD = 1e-10
