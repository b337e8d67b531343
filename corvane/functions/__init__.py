"""Part of Corvane; see README.md."""
