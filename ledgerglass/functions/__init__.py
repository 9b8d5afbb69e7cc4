"""Scalar building blocks: all return Columns or plain values."""
