"""Reading and writing of files and streams."""
