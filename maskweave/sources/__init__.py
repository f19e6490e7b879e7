"""Reading documents and term files, writing results."""
