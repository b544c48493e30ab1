"""Reading and writing datasets at the edges: CSV, JSON rows, run logs, transcripts and files."""
