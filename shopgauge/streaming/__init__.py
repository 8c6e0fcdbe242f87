"""Structured Streaming: continuous anomaly flagging of arriving sales files."""
