"""Schema, rules, patterns and plan languages, lowered to DataFrames."""
