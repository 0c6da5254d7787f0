"""Stored state: batches, versions, ledgers, seeds. All of it lies in paths, whatever file system they name."""
