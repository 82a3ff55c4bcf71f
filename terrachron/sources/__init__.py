"""Readers, generators and writers of observations."""
