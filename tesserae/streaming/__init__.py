"""Streams of jobs and conversations."""
