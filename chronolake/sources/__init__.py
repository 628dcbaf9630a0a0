"""Where points are stored, read and written."""
