"""Operators for preparing large text corpora; see the README of the repository."""
