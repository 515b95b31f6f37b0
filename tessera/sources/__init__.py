"""Readers and sinks: repositories, histories, configuration, worker answers, expectations."""
