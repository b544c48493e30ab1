"""gridweave: messy spreadsheet-like data and run analytics as Spark plans."""
