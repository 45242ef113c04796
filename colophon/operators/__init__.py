"""DataFrame operators: matching, merging, references, joins, relations, publication."""
