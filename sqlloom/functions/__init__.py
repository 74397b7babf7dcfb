"""Part of the sqlloom engine."""
