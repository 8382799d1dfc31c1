"""Cubes that grow: observations arrive as a stream."""
