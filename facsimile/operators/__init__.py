"""The library proper.  Module docstrings carry the SURVEY §2 operator ids."""
