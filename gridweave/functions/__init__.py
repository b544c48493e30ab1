"""Column expressions: cell typing, regex helpers and text helpers."""
