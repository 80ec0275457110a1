"""Block streams from a folder."""
