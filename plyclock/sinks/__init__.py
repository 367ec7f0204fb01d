from plyclock.sinks.writers import quarantine, write_extremes_text, write_moves, write_pairs, write_table

__all__ = ["quarantine", "write_extremes_text", "write_moves", "write_pairs", "write_table"]
