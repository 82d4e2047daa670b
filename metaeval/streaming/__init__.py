"""The stateless row preparation applied to streams."""
