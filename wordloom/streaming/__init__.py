"""The row-local operators over streams of sentences."""
