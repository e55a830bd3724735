"""Configuration, time, and the order of stages."""
