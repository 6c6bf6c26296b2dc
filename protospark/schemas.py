"""Schemas and keys of the tables that the operators take."""

from __future__ import annotations

HITS = "spacer_id string, contig_id string, spacer_length int, strand boolean, start long, `end` long, mismatches int, tool string"
TRUTH = "spacer_id string, contig_id string, start long, `end` long, strand boolean, mismatches int"
GROUP_KEY = ["spacer_id", "contig_id", "strand"]
HIT_KEY = ["spacer_id", "contig_id", "start", "end", "strand"]
