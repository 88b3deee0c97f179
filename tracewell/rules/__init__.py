"""The rule language: packs of rules as data."""
