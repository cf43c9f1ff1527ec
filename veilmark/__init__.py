"""Finding, scoring and removing personal data in DataFrames of text."""
