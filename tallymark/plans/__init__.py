"""Composite controls: one plan per control, all subjects in one job."""
