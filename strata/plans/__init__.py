"""Runs: build, gate, approve, publish, roll back, restore, and what is recorded of them."""
