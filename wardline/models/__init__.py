"""Fit/transform models: imputation, statistics, detectors, tuning and attribution."""
