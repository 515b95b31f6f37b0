"""Incremental evidence: fingerprints and rates of files as they arrive.

A scan is a batch.  What is per file, though, needs no batch, and is offered as a stream too.
"""
