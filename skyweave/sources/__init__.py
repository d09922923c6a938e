"""Headers, catalogues on disk, opening and writing."""
