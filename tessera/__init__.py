"""Part of the tessera analytics library."""
