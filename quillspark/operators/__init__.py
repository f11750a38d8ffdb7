"""What statements compile to: matching, scoring, facets, buckets, groups, order, snippets."""
