"""Readers for corpora, rule packs, exemptions, targets and saved reports."""
