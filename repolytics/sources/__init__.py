"""Readers and writers of source trees, Git dumps and model documents."""
