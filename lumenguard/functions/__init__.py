"""Column functions: the rule pack, its validators, spans of matches, normalisation and masks."""
