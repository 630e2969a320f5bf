"""DataFrame → DataFrame operators of the loss, health, report and check models."""
