"""Plans of work: chunks, guarded chunks and device limits."""
