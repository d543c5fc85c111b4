"""Variant-graph analytics on Spark: haplotype and founder-sequence alignments as DataFrame plans."""
