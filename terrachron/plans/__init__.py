"""Reusable multi-job plans: written tables in the shared folder, connected components."""
